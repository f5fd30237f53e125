"""Parsing and formatting of telemetry, commands, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


INTS = ("S", "M1", "M2", "M3", "H", "G", "C")
FLOATS = ("Z", "R", "P", "VR", "VP")
REQUIRED = ("Z", "R", "P", "S")


def round_even(x: Column, digits: int) -> Column:
    """Rounded to decimals; a half, told by the scaled double, goes to even."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def fixed(x: Column, digits: int = 2) -> Column:
    """Fixed decimals, halves to even as the writers of the lines round."""
    return F.format_string(f"%.{digits}f", round_even(x, digits))


def telemetry_items(line: Column) -> Column:
    """(key, value) of each item; value NULL where there is no '='."""
    body = F.regexp_replace(F.trim(line), "^TLM:", "")
    return F.transform(F.split(body, ","), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.when(F.contains(x, F.lit("=")), F.trim(F.regexp_replace(x, "^[^=]*=", ""))).alias("v")))


def item(items: Column, key: str, last: bool = False) -> Column:
    found = F.filter(items, lambda x: x["k"] == key)
    return F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1)["v"])


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


#: A whole and a decimal number.
_WHOLE = "^[-+]?[0-9]{1,18}$"
_NUMBER = "^[-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?$"


def parse_telemetry(line: Column) -> Column:
    """Strict: a struct, or NULL if the prefix, an item, a required key or a
    number is missing, or a key stands twice.  The line is parted once at its
    commas and each item at its first equals sign; what is no number is told by
    a pattern, before any cast can fail."""

    def items(text: Column) -> Column:
        return F.when(text.startswith("TLM:"), F.split(F.substr(text, F.lit(5)), ",")).otherwise(F.array(F.lit("")))

    def parted(parts: Column) -> Column:
        keys = F.transform(parts, lambda x: F.trim(F.substring_index(x, "=", 1)))
        values = F.transform(parts, lambda x: F.trim(F.substr(x, F.instr(x, "=") + 1)))
        return F.struct(keys.alias("k"), values.alias("v"), F.forall(parts, lambda x: F.instr(F.ltrim(x), "=") > 1).alias("whole"))

    def read(t: Column) -> Column:
        # the first value of a key; NULL where it is absent
        at = {k: F.get(t["v"], F.nullif(F.array_position(t["k"], k), F.lit(0)).cast("int") - 1) for k in INTS + FLOATS}
        whole = t["whole"] & (F.size(t["k"]) == F.size(F.array_distinct(t["k"])))
        return F.struct(*[v.alias(k) for k, v in at.items()], whole.alias("whole"))

    def numbers(t: Column) -> Column:
        value = {k: F.when(t[k].rlike(_WHOLE), t[k].cast("long")) if k in INTS else F.when(t[k].rlike(_NUMBER), t[k].cast("double")) for k in INTS + FLOATS}
        return F.struct(*[v.alias(k) for k, v in value.items()], *[t[k].isNull().alias(f"no_{k}") for k in value], t["whole"].alias("whole"))

    def checked(t: Column) -> Column:
        ok = t["whole"]
        for k in INTS + FLOATS:
            good = F.coalesce(t[k].between(-(2**31), 2**31 - 1) if k in INTS else F.abs(t[k]) < float("inf"), F.lit(False))
            ok = ok & (good if k in REQUIRED else good | t[f"no_{k}"])
        return F.when(ok, F.struct(t["Z"].alias("z"), t["R"].alias("roll"), t["P"].alias("pitch"), (t["S"] == 1).alias("stable"), F.coalesce(t["H"] == 1, F.lit(False)).alias("homing"), t["VR"].alias("vr"), t["VP"].alias("vp")))

    out = F.trim(line)
    for step in (items, parted, read, numbers, checked):
        out = bound(out, step)
    return out


def parse_lenient(line: Column) -> Column:
    """Items without '=' are skipped, the last of a key counts, missing is 0."""
    return bound(telemetry_items(line), lambda items: F.struct(*[F.coalesce(item(items, k, last=True).try_cast("double"), F.lit(0.0)).alias(k) for k in ("Z", "R", "P", "S")]))


def pose_command(z: Column, roll: Column, pitch: Column) -> Column:
    return F.concat(F.lit("Z:"), fixed(z), F.lit(" R:"), fixed(roll), F.lit(" P:"), fixed(pitch), F.lit("\r\n"))


def z_directory(z: Column) -> Column:
    """A folder name of a height with at most two decimals."""
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", z), r"0+$", ""), r"\.$", "")
    return F.concat(F.lit("z_"), F.replace(F.replace(s, F.lit("-"), F.lit("minus_")), F.lit("."), F.lit("_")))


def display_judgement(j: Column) -> Column:
    return F.when(j.isin("OK", "NORMAL"), "NORMAL").when(j.isin("NG", "DEFECT"), "DEFECT").otherwise(j)


def number_list(s: Column) -> Column:
    """Numbers of a comma list; blanks are skipped."""
    return F.transform(F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.try_cast("double"))
