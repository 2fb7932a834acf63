"""Metadata from paths, and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sensors of a recording, by position.
SENSORS = ("Tachometer", "UH Axial Acc", "UH Radial Acc", "UH Tangential Acc", "OH Axial Acc", "OH Radial Acc", "OH Tangential Acc", "Microphone")
ACCELEROMETERS = SENSORS[1:7]
#: How a fault shows in a path. The first rule that holds wins.
COMPONENT_RULES = ("normal", "imbalance")
SUBSTRING_RULES = (("horizontal-", "horizontal-misalignment"), ("vertical-misalignment", "vertical-misalignment"))
BEARING_RULES = ("overhang", "underhang")


def parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\\", "/"), "/")


def _after(path: Column, name: str, n: int) -> Column:
    """The component n places after the first one called name; null if there is none."""
    at = F.array_position(parts(path), name).cast("int")
    return F.when(at > 0, F.get(parts(path), at - 1 + n))


def _rules(path: Column, substring: Column | None = None):
    for name in COMPONENT_RULES:
        yield F.array_contains(parts(path), name), F.lit(name), F.lit("") if name == "normal" else _after(path, name, 1)
    for inside, name in SUBSTRING_RULES:
        yield path.contains(inside), F.lit(name), _after(path, name, 1)
    for name in BEARING_RULES:
        yield F.array_contains(parts(path), name), F.concat(F.lit(f"{name}-"), _after(path, name, 1)), _after(path, name, 2)


def _first(path: Column, which: int, otherwise: str) -> Column:
    out = None
    for rule in _rules(path):
        out = F.when(rule[0], rule[which]) if out is None else out.when(rule[0], rule[which])
    return out.otherwise(F.lit(otherwise))


def fault_type(path: Column) -> Column:
    return _first(path, 1, "unknown")


def fault_severity(path: Column) -> Column:
    return _first(path, 2, "")


def path_is_broken(path: Column) -> Column:
    """Whether a substring rule holds although no component bears the fault's name: such files are errors."""
    return F.coalesce(fault_type(path).isNull() | fault_severity(path).isNull(), F.lit(True)) & ~F.array_contains(parts(path), "normal")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix: 13.1072.csv gives 13.1072."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def rpm(path: Column) -> Column:
    """Rotations a minute from a stem in hertz, half to even; -1 if it is no number."""
    return F.coalesce(F.bround(stem(path).try_cast("double") * 60, 0).cast("int"), F.lit(-1))


def array_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.[^./]*$", "")


def temp_name(path: Column, suffix: str = "_tmp") -> Column:
    """suffix before the extension."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", "$1" + suffix + "$2")


def with_defaults(fault: Column, severity: Column, speed: Column) -> tuple[Column, Column, Column]:
    """What readers take for missing metadata."""
    return F.coalesce(fault, F.lit("unknown")), F.coalesce(severity, F.lit("")), F.coalesce(speed, F.lit(0.0))


def label_of(fault: Column, severity: Column, strategy: str = "only types", group_misalignment: bool = False) -> tuple[Column, Column]:
    """Label and severity. `types & severity` joins both and overrides grouping; grouping makes one label of all
    misalignments and moves the direction into the severity; any other strategy leaves both as they are."""
    if strategy == "types & severity":
        return F.concat(fault, severity), severity
    if group_misalignment:
        bent = fault.contains("misalignment")
        return F.when(bent, "misalignment").otherwise(fault), F.when(bent, F.concat(F.split(fault, "-")[0], severity)).otherwise(severity)
    return fault, severity


def member(column: Column, wanted, strict: bool = False) -> Column:
    """Predicate of a class or severity: `all`, a list, or one value. strict: a bare string is a substring test."""
    if isinstance(wanted, str) and wanted == "all":
        return F.lit(True)
    if isinstance(wanted, str):
        return F.lit(wanted).contains(column) if strict else column == wanted
    return column.isin(list(wanted))


def mixed(key: Column, seed: int) -> Column:
    """A portable order key: the same in any SQL engine for keys below 2**31."""
    return (key.cast("long") * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)
