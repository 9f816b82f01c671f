"""Identifiers, names, lengths and other short texts (SC-7, 8, 9, 11, 12, 14, 15, 30, 31, 33, 35..37)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def curie(uri: Column, prefixes: Mapping[str, str]) -> Column:
    """``prefix:rest`` where the URI starts with a namespace (the longest that does), else the URI."""
    out = None
    for space, prefix in sorted(prefixes.items(), key=lambda p: (-len(p[0]), p[0])):
        value = F.concat(F.lit(f"{prefix}:"), F.substring(uri, len(space) + 1, F.length(uri)))
        out = F.when(F.startswith(uri, F.lit(space)), value) if out is None else out.when(F.startswith(uri, F.lit(space)), value)
    return uri if out is None else out.otherwise(uri)


def normalised_id(identifier: Column) -> Column:
    """Leading zeros of every ``:`` part stripped, but for a last digit."""
    return F.regexp_replace(identifier, r"(^|:)0+(?=[^:])", "$1")


def decoded_id(tag: Column) -> Column:
    """Escapes of drawing programs undone: ``_xHH_`` a character, ``_`` a blank; a number
    added to make the id unique is dropped."""
    bare = F.regexp_replace(tag, r"_\d+_$", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"(?s)(_x[0-9A-Fa-f]{2}_|.)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) == 5, F.char(F.conv(F.substring(t, 3, 2), 16, 10).cast("int"))).when(t == "_", " ").otherwise(t)), "")


def markup_of(title: Column, tag: Column) -> Column:
    """An element's markup: its title, else its decoded id."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), decoded_id(tag))


def short_id(identifier: Column) -> Column:
    """``SHAPE_7`` to ``ID-00000007``; a layer's part before the last ``/`` stays out."""
    return F.concat(F.lit("ID-"), F.lpad(F.substring_index(F.substring_index(identifier, "/", -1), "_", -1), 8, "0"))


def readable(identifier: Column) -> Column:
    return F.initcap(F.replace(F.replace(identifier, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))


def css_class(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9\-]", "-"))


# Pixels of a length unit at 96 to the inch, and points of it.
PIXELS = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "pt": 96.0 / 72.0, "pc": 16.0, "em": 16.0, "ex": 8.0}


def pixels(length: Column, whole: Column | None = None) -> Column:
    """A length with its unit in pixels; ``%`` is of ``whole``; an unknown unit is null."""
    number = F.regexp_extract(length, r"^\s*(-?[0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(length, r"^\s*-?[0-9.]+\s*([A-Za-z%]*)\s*$", 1))
    scale = F.create_map(*[F.lit(x) for kv in PIXELS.items() for x in kv])
    out = number * F.element_at(scale, unit)
    return F.when(unit == "%", number * whole / 100).otherwise(out) if whole is not None else out


def points(length: Column) -> Column:
    return pixels(length) * 72 / 96


def node_name(term: Column, layers: Column) -> Column:
    """Layers outermost first, then the term, parted by ``/``."""
    return F.concat_ws("/", F.reverse(layers), term)


def full_name(label: Column, layer_labels: Column) -> Column:
    return F.when(F.size(layer_labels) > 0, F.concat(label, F.lit(" in "), F.array_join(layer_labels, ", "))).otherwise(label)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name`` in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def dataset_link(resource: Column) -> Column:
    """The dataset page of a resource URL: its number and version follow ``datasets`` and ``versions``."""
    number, version = F.regexp_extract(resource, r"/datasets/(\d+)", 1), F.regexp_extract(resource, r"/versions?/(\d+)", 1)
    return F.when(number != "", F.concat_ws("/", F.lit("dataset"), number, F.nullif(version, F.lit(""))))


def nerve_text(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("g."), F.lit("ganglion")), F.lit("n."), F.lit("nerve"))


def capitalised(label: Column) -> Column:
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, F.length(label)))


def is_system_name(name: Column) -> Column:
    return (F.length(name) > 6) & (name == F.upper(name))


def clean_properties(props: Column) -> Column:
    """A property map as it is output: nulls and empty texts are not set."""
    return F.map_filter(props, lambda k, v: v.isNotNull() & (v != ""))


def appended(values: Column, value: Column) -> Column:
    """``value`` added to a list that may be null; a null value adds nothing."""
    base = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(value.isNull(), base).otherwise(F.array_append(base, value))


def tag(markup: str, name: str) -> Column:
    """SC-6: the text of ``name(...)`` in a markup, empty where there is none."""
    return F.regexp_extract(markup, rf"\b{name}\(([^)]*)\)", 1)
