"""Perceptual colour difference as one expression (JN-24)."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct whose fields are worked out once."""
    bound = F.array(F.struct(*[c.alias(k) for k, c in values.items()]))
    return F.element_at(F.transform(bound, body), 1)


def rgb(colour: Column) -> dict[str, Column]:
    """Channels 0..1 of ``#rrggbb`` or ``#rgb``; anything else is null."""
    h = F.regexp_replace(F.lower(colour), "^#", "")
    full = F.when(h.rlike("^[0-9a-f]{6}$"), h).when(h.rlike("^[0-9a-f]{3}$"), F.regexp_replace(h, "(.)", "$1$1"))
    return {c: F.conv(F.substring(full, k, 2), 16, 10).cast("double") / 255 for c, k in (("r", 1), ("g", 3), ("b", 5))}


def lab(colour: Column) -> Column:
    """CIE L*a*b* (D65) of an sRGB colour: a struct ``(l, a, b)``."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    f = lambda t: F.when(t > 0.008856451679035631, F.cbrt(t)).otherwise(t * 7.787037037037035 + 4 / 29)

    def tristimulus(s: Column) -> Column:
        r, g, b = s["r"], s["g"], s["b"]
        xyz = {"x": (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047, "y": 0.2126729 * r + 0.7151522 * g + 0.0721750 * b, "z": (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883}
        return let(xyz, lambda t: let({k: f(t[k]) for k in "xyz"}, lambda v: F.struct((116 * v["y"] - 16).alias("l"), (500 * (v["x"] - v["y"])).alias("a"), (200 * (v["y"] - v["z"])).alias("b"))))

    return let(rgb(colour), lambda c: let({k: linear(c[k]) for k in "rgb"}, tristimulus))


def delta_e(p: Column, q: Column) -> Column:
    """CIEDE2000 between two structs ``(l, a, b)``."""
    seventh = lambda c: F.sqrt(F.pow(c, F.lit(7)) / (F.pow(c, F.lit(7)) + 25.0**7))
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))

    def scaled(s: Column) -> Column:
        g = 1.5 - 0.5 * seventh((F.hypot(s["a1"], s["b1"]) + F.hypot(s["a2"], s["b2"])) / 2)
        return let({"l1": s["l1"], "l2": s["l2"], "b1": s["b1"], "b2": s["b2"], "g": g}, lambda v: let({"l1": v["l1"], "l2": v["l2"], "b1": v["b1"], "b2": v["b2"], "a1": s["a1"] * v["g"], "a2": s["a2"] * v["g"]}, polar))

    def polar(s: Column) -> Column:
        return let({"l1": s["l1"], "l2": s["l2"], "c1": F.hypot(s["a1"], s["b1"]), "c2": F.hypot(s["a2"], s["b2"]), "h1": hue(s["a1"], s["b1"]), "h2": hue(s["a2"], s["b2"])}, differences)

    def differences(s: Column) -> Column:
        h1, h2, grey = s["h1"], s["h2"], s["c1"] * s["c2"] == 0
        dh = F.when(grey, 0.0).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
        mh = F.when(grey, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
        return let({"dl": s["l2"] - s["l1"], "dc": s["c2"] - s["c1"], "dh": 2 * F.sqrt(s["c1"] * s["c2"]) * F.sin(F.radians(dh) / 2), "ml": (s["l1"] + s["l2"]) / 2 - 50, "mc": (s["c1"] + s["c2"]) / 2, "mh": mh}, weighted)

    def weighted(s: Column) -> Column:
        cos = lambda k, off: F.cos(F.radians(k * s["mh"] - off))
        t = 1 - 0.17 * cos(1, 30) + 0.24 * cos(2, 0) + 0.32 * cos(3, -6) - 0.20 * cos(4, 63)
        turn = 60 * F.exp(-F.pow((s["mh"] - 275) / 25, F.lit(2)))
        terms = {
            "x": s["dl"] / (1 + 0.015 * s["ml"] * s["ml"] / F.sqrt(20 + s["ml"] * s["ml"])), "y": s["dc"] / (1 + 0.045 * s["mc"]), "z": s["dh"] / (1 + 0.015 * s["mc"] * t),
            "r": -2 * F.sin(F.radians(turn)) * seventh(s["mc"]),
        }
        return let(terms, lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"] + v["r"] * v["y"] * v["z"]))

    return let({"l1": p["l"], "a1": p["a"], "b1": p["b"], "l2": q["l"], "a2": q["a"], "b2": q["b"]}, scaled)


THRESHOLD = 6.0
