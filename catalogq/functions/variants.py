"""Reading loosely typed JSON: every getter answers NULL for a value of the wrong kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.ingest import (
    bare_text,
    clean_text,
    digits,
    euro_amount,
    first_integer,
    german_date,
    join_texts,
    to_double,
    to_long,
)

# Types of description groups and their parts. Whole groups are read at once; a part of another kind is NULL.
LINK = "struct<linkText:string,href:string>"
DEFINITION = "struct<title:string,description:string>"
BLOCK = (
    f"struct<texts:array<string>,bulletpoints:array<string>,links:array<{LINK}>,"
    f"descriptionList:array<{DEFINITION}>,table:array<array<string>>>"
)
GROUP = f"struct<header:string,contentBlock:array<{BLOCK}>>"


class Members:
    """The members of a document that columns ask for, by path, read in one pass over it.

    The getters below take it in place of a variant. A path that is asked for as several types is
    kept as a variant; each type comes from there.
    """

    def __init__(self, column: str, kinds: dict[str, set[str]] | None = None):
        self.column, self.fixed = column, kinds is not None
        self.kinds: dict[str, set[str]] = {} if kinds is None else kinds
        self.texts: list[str] = []

    def get(self, path: str, kind: str) -> Column:
        if not self.fixed:
            self.kinds.setdefault(path, set()).add(kind)
        member = F.col(self.column)
        for name in path.removeprefix("$.").split("."):
            member = member[name]
        return member if len(self.kinds[path]) == 1 else F.try_variant_get(member, "$", kind)

    def text(self, path: str) -> Column:
        """The cleaned text of a member; NULL for a blank one costs no array where the text is a column."""
        self.get(path, "string")
        if path not in self.texts:
            self.texts.append(path)
        found = F.col(f"{self.column}_{self.texts.index(path)}")
        return F.when(found != "", found)

    def of(self, docs: DataFrame, doc: str, *kept: str) -> DataFrame:
        """The kept columns, the members and their bare texts: in steps of their own, so that each is read once."""
        texts = [bare_text(self.get(p, "string")).alias(f"{self.column}_{i}") for i, p in enumerate(self.texts)]
        return docs.select(*kept, self.read(F.col(doc))).select(*kept, self.column, *texts)

    def read(self, doc: Column) -> Column:
        """All members as one struct, NULL where a path leads nowhere or to the wrong kind."""
        tree: dict = {}
        for path, kinds in self.kinds.items():
            *above, last = path.removeprefix("$.").split(".")
            place = tree
            for name in above:
                place = place.setdefault(name, {})
            place[last] = next(iter(kinds)) if len(kinds) == 1 else "variant"

        def kind(node: dict | str) -> str:
            return node if isinstance(node, str) else f"struct<{','.join(f'`{n}`:{kind(x)}' for n, x in node.items())}>"

        return F.try_variant_get(doc, "$", kind(tree)).alias(self.column)


def members(make: Callable[[Members], dict[str, Column]], column: str) -> tuple[Members, dict[str, Column]]:
    """The members that columns ask for, and the columns."""
    asked = Members(column)
    make(asked)
    known = Members(column, asked.kinds)
    return known, make(known)


def _get(value: Column | Members, path: str, kind: str) -> Column:
    return value.get(path, kind) if isinstance(value, Members) else F.try_variant_get(value, path, kind)


def text(value: Column | Members, path: str = "$") -> Column:
    """Any scalar as cleaned text; an object or array as its JSON."""
    if isinstance(value, Members):
        return value.text(path)
    return clean_text(_get(value, path, "string"))


def boolean(value: Column | Members, path: str) -> Column:
    """A JSON boolean only: the text 'true' has no numeric reading, the boolean has one."""
    found = _get(value, path, "string")
    real = found.isin("true", "false") & _get(value, path, "long").isNotNull()
    return F.when(real, found == "true")


def whole(value: Column | Members, path: str) -> Column:
    return to_long(text(value, path))


def decimal(value: Column | Members, path: str) -> Column:
    return to_double(text(value, path))


def article_digits(value: Column | Members, path: str) -> Column:
    return digits(text(value, path))


def euros(value: Column | Members, path: str) -> Column:
    """A JSON number as it is; text by the shop's spelling rules.

    A plain spelling means the same either way. Only one with an exponent needs the
    type: as text its 'E' is dropped like any other letter.
    """
    shown = text(value, path)
    kind = F.schema_of_variant(_get(value, path, "variant"))
    return (
        F.when(shown.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), shown.try_cast("double"))
        .when(shown.rlike(r"[eE][+-]?[0-9]+$") & (kind != "STRING"), to_double(shown))
        .otherwise(euro_amount(shown))
    )


def integer_in(value: Column | Members, path: str) -> Column:
    return first_integer(text(value, path))


def date_in(value: Column | Members, path: str) -> Column:
    return german_date(text(value, path))


def items(value: Column | Members, path: str = "$", kind: str = "variant") -> Column:
    """The elements of a JSON array, NULL where they are of another kind; none for anything else."""
    return F.coalesce(_get(value, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def texts(value: Column | Members, path: str) -> Column:
    """The cleaned texts of the elements of a JSON array that have one."""
    return F.array_remove(F.array_compact(F.transform(items(value, path, "string"), bare_text)), "")


def is_object(value: Column | Members, path: str = "$") -> Column:
    return _get(value, path, "struct<>").isNotNull()


def labels(elements: Column, keys: tuple[str, ...]) -> Column:
    """Texts of badge-like elements: the named members of an object, or a scalar itself."""

    def of(element: Column) -> Column:
        return F.when(is_object(element), F.array(*[text(element, f"$.{k}") for k in keys])).otherwise(
            F.array(text(element))
        )

    return F.filter(F.flatten(F.transform(elements, of)), lambda t: t.isNotNull())


def content_texts(block: Column) -> Column:
    """The texts of one content block: paragraphs, bullets, links, definitions, tables.

    Texts are left as they are where they stand alone: joining the blocks cleans them and drops blank ones.
    """

    def listed(name: str, kind: str = "string") -> Column:
        return F.coalesce(block[name], F.array().cast(f"array<{kind}>"))

    def definition(item: Column) -> Column:
        # Parts that are missing leave no separator behind.
        return F.array_join(F.array(clean_text(item["title"]), clean_text(item["description"])), ": ")

    def row_text(cells: Column) -> Column:
        return F.array_join(F.transform(cells, lambda x: F.coalesce(bare_text(x), F.lit(""))), " / ")

    rows = F.filter(listed("table", "array<string>"), lambda r: F.size(r) > 0)
    return F.concat(
        listed("texts"),
        listed("bulletpoints"),
        F.flatten(F.transform(listed("links", LINK), lambda x: F.array(x["linkText"], x["href"]))),
        F.transform(listed("descriptionList", DEFINITION), definition),
        F.array(F.array_join(F.transform(rows, row_text), " || ")),
    )


def group_text(group: Column) -> Column:
    """All texts of a description group (a GROUP), each once, one per line."""
    blocks = F.coalesce(group["contentBlock"], F.array().cast(f"array<{BLOCK}>"))
    return join_texts(F.flatten(F.transform(blocks, content_texts)), "\n")


def description_groups(groups: Column, headers: tuple[str, ...]) -> Column:
    """(header, body) of every group (a GROUP) with a header; bodies only for the listed headers."""

    def titled(group: Column) -> Column:
        return F.struct(clean_text(group["header"]).alias("header"), group.alias("group"))

    def section(entry: Column) -> Column:
        body = F.when(entry["header"].isin(*headers), group_text(entry["group"]))
        return F.struct(entry["header"].alias("header"), body.alias("body"))

    return F.transform(F.filter(F.transform(groups, titled), lambda g: g["header"].isNotNull()), section)
