"""Markup written into shape names, layer notes and list texts (SC-1, 2, 4, 5, 6, 10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the markup.
WITH_ARGUMENT = ("id", "class", "children", "name", "style", "path")
FLAGS = ("background", "boundary", "closed", "exterior", "interior", "centreline", "divider", "group", "invisible", "marker", "node", "region", "siblings", "styling")
DEPRECATED = ("marker", "siblings", "style")

_ID = r"[A-Za-z0-9][A-Za-z0-9:/_.\-]*"
_ARGS = rf"\b(id|class|children|path)\s*\(\s*({_ID})\s*\)"
_NAME = r"\bname\s*\(\s*([^()]+?)\s*\)"
_STYLE = r"\bstyle\s*\(\s*(\d+)\s*\)"
_DETAILS = rf"\bdetails\s*\(\s*({_ID})\s*,\s*(\d+)\s*\)"
_FLAG = rf"(?<![\w(:/.\-])({'|'.join(FLAGS)})(?![\w:/.\-(])"


def argument(markup: Column, word: str) -> Column:
    """The last argument of ``word(...)``, or null."""
    pattern = {"name": _NAME, "style": _STYLE}.get(word, rf"\b{word}\s*\(\s*({_ID})\s*\)")
    return F.try_element_at(F.regexp_extract_all(markup, F.lit(pattern), 1), F.lit(-1))


def flags(markup: Column) -> Column:
    """The flags set, sorted; what stands in brackets does not count."""
    bare = F.regexp_replace(markup, r"\([^()]*\)", "()")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(_FLAG), 1)))


def residue(markup: Column) -> Column:
    """What is left once the leading dot and all known directives are taken out."""
    out = F.regexp_replace(markup, r"^\s*\.", "")
    for pattern in (_DETAILS, _ARGS, _NAME, _STYLE, _FLAG):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def parsed(markup: Column) -> dict[str, Column]:
    """Columns of a shape's markup; a text that is not markup is an error."""
    found = flags(markup)
    details = F.try_element_at(F.regexp_extract_all(markup, F.lit(_DETAILS), 1), F.lit(-1))
    maxzoom = (F.try_element_at(F.regexp_extract_all(markup, F.lit(_DETAILS), 2), F.lit(-1)).cast("int") - 1).alias("maxzoom")
    old = F.filter(F.array(*[F.when(F.array_contains(found, w) if w in FLAGS else argument(markup, w).isNotNull(), w) for w in DEPRECATED]), lambda w: w.isNotNull())
    bad = ~F.startswith(F.ltrim(markup), F.lit(".")) | (residue(markup) != "")
    lone = F.array_contains(found, "styling") & (argument(markup, "id").isNotNull() | argument(markup, "class").isNotNull())
    return {
        "id": argument(markup, "id"), "class": argument(markup, "class"), "children": argument(markup, "children"), "name": argument(markup, "name"), "path": argument(markup, "path"),
        "flags": found, "details": details, "maxzoom": maxzoom,
        "warning": F.when(F.size(old) > 0, F.concat(F.lit("Deprecated `"), F.array_join(old, ", "), F.lit("`"))),
        "error": F.when(lone, "'styling' element can't have an 'id' nor 'class'").when(bad, "Syntax error"),
    }


def layer_directive(note: Column) -> dict[str, Column]:
    """Columns of a layer's notes: id, models and the three zoom levels."""
    zoom = r"\bzoom\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)"
    model = r"\bmodels\s*\(\s*((?:ABI|FM|FMA|ILX|MA|NCBITaxon|UBERON):[A-Za-z0-9][A-Za-z0-9:/_.\-]*)\s*\)"
    left = F.regexp_replace(note, r"^\s*\.", "")
    for pattern in (zoom, model, rf"\bid\s*\(\s*{_ID}\s*\)"):
        left = F.regexp_replace(left, pattern, " ")
    last = lambda pattern, group: F.try_element_at(F.regexp_extract_all(note, F.lit(pattern), group), F.lit(-1))
    return {
        "id": argument(note, "id"), "models": last(model, 1),
        "zoom": F.when(last(zoom, 1).isNotNull(), F.array(*[last(zoom, k).cast("int") for k in (1, 2, 3)])),
        "error": F.when(~F.startswith(F.ltrim(note), F.lit(".")) | (F.trim(left) != ""), "Syntax error in layer directive"),
    }


def id_list(text: Column) -> Column:
    """``a, b, c`` to an array; null unless every part is an id."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.when(F.forall(parts, lambda p: p.rlike(f"^{_ID}$")), parts)


def route_list(text: Column) -> Column:
    """``a, b, (c, d)`` to an array of groups; null unless well formed."""
    group = rf"\(\s*{_ID}(?:\s*,\s*{_ID})*\s*\)|{_ID}"
    groups = F.regexp_extract_all(text, F.lit(f"({group})"), 1)
    ok = text.rlike(rf"^\s*(?:{group})(?:\s*,\s*(?:{group}))*\s*$")
    return F.when(ok, F.transform(groups, lambda g: F.transform(F.split(F.regexp_replace(g, r"[()]", ""), ","), lambda p: F.trim(p))))


def route(groups: Column) -> dict[str, Column]:
    """A route's start and end groups and the nodes between; under two groups is an error."""
    n = F.size(groups)
    return {
        "start_nodes": F.when(n >= 2, F.try_element_at(groups, F.lit(1))), "through_nodes": F.when(n >= 2, F.flatten(F.slice(groups, 2, F.greatest(n - 2, F.lit(0))))),
        "end_nodes": F.when(n >= 2, F.try_element_at(groups, F.lit(-1))), "error": F.when(n < 2, "Route definition is too short"),
    }
