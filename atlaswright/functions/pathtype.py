"""Neuron path types: codes, names, viewer kinds and what phenotypes say (SC-13, 30, 34, WN-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_MASK, ORDER_MASK = 31, 96
POST, PRE = 32, 64
# Code, name and viewer kind.
TYPES = [
    (0, "unknown", "unknown"),
    (1, "central nervous system", "cns"),
    (2, "enteric", "enteric"),
    (3, "excitatory", "excitatory"),
    (4, "inhibitory", "inhibitory"),
    (5, "intestinal", "intestinal"),
    (6, "intracardiac", "intracardiac"),
    (7, "motor", "somatic"),
    (8, "parasympathetic", "para"),
    (9, "sensory", "sensory"),
    (10, "spinal ascending", "cns"),
    (11, "spinal descending", "cns"),
    (12, "sympathetic", "symp"),
]
# The codes of phenotypes.
PHENOTYPES = {
    "ilxtr:EntericPhenotype": 2,
    "ILX:0104003": 3,
    "ILX:0105486": 4,
    "ilxtr:IntestinoFugalProjectionPhenotype": 5,
    "ilxtr:IntrinsicPhenotype": 6,
    "ilxtr:MotorPhenotype": 7,
    "ilxtr:ParasympatheticPhenotype": 8,
    "ilxtr:SensoryPhenotype": 9,
    "ilxtr:SpinalCordAscendingProjectionPhenotype": 10,
    "ilxtr:SpinalCordDescendingProjectionPhenotype": 11,
    "ilxtr:SympatheticPhenotype": 12,
    "ilxtr:PostGanglionicPhenotype": 32,
    "ilxtr:PreGanglionicPhenotype": 64,
}


def _of(code: Column, which: int) -> Column:
    table = F.create_map(*[F.lit(x) for row in TYPES for x in (row[0], row[which])])
    return F.coalesce(F.element_at(table, code.bitwiseAND(F.lit(TYPE_MASK)).cast("int")), F.lit("unknown"))


def _order(code: Column, post: str, pre: str) -> Column:
    bits = code.bitwiseAND(F.lit(ORDER_MASK))
    return F.when(bits == POST, post).when(bits == PRE, pre).otherwise("")


def name(code: Column) -> Column:
    return F.concat(_order(code, "post-ganglionic ", "pre-ganglionic "), _of(code, 1))


def viewer_kind(code: Column) -> Column:
    return F.concat(_of(code, 2), _order(code, "-post", "-pre"))


def is_dashed(code: Column) -> Column:
    return F.endswith(viewer_kind(code), F.lit("-post"))


def from_phenotypes(phenotypes: Column) -> Column:
    """The code of the first phenotype that names a type, with the bits of the first that
    names an order; without a type, that of the central nervous system."""
    codes = F.create_map(*[F.lit(x) for kv in PHENOTYPES.items() for x in kv])
    known = F.filter(F.transform(phenotypes, lambda p: F.element_at(codes, p)), lambda c: c.isNotNull())
    kind = F.get(F.filter(known, lambda c: c <= TYPE_MASK), F.lit(0))
    order = F.get(F.filter(known, lambda c: c > TYPE_MASK), F.lit(0))
    return F.coalesce(kind, F.lit(1)).bitwiseOR(F.coalesce(order, F.lit(0)))


def drawn(code: Column, style: Column) -> Column:
    """The code of a drawn line: (para)sympathetic ones are pre-ganglionic when dotted or dashed, else post."""
    autonomic = code.bitwiseAND(F.lit(TYPE_MASK)).isin(8, 12)
    return F.when(autonomic, code.bitwiseOR(F.when(style.rlike("dot|dash"), PRE).otherwise(POST))).otherwise(code)
