"""Column functions: class names, sizes, percentages, CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element types in descriptors.
PRIMITIVES = {"Z": "boolean", "C": "char", "F": "float", "D": "double", "B": "byte", "S": "short", "I": "int", "J": "long"}


def class_name(raw: Column) -> Column:
    """Java's way to write an internal name: [Ljava/lang/Object; is java.lang.Object[], [[I is int[][]."""
    depth = F.length(F.regexp_extract(raw, r"^(\[+)", 1))
    element = F.regexp_replace(raw, r"^\[+", "")
    names = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    plain = F.when(element.rlike("^L.*;$"), F.regexp_replace(element, "^L|;$", "")).otherwise(F.coalesce(F.when(F.length(element) == 1, F.try_element_at(names, element)), element))
    dotted = lambda c: F.translate(c, "/", ".")
    return F.when(depth > 0, F.concat(dotted(plain), F.repeat(F.lit("[]"), depth))).otherwise(dotted(raw))


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / F.lit(float(1024**power)))).otherwise(out)
    return out


def share_text(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, or N/A without a whole."""
    return F.when(whole > 0, F.concat(F.format_string("%.1f", part * 100.0 / whole), F.lit("%"))).otherwise("N/A")


def csv_cell(value: Column, safe: bool = True) -> Column:
    """A quoted cell; if safe, text that a spreadsheet would take for a formula starts with an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if safe:
        text = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *(csv_cell(c) for c in cells))


def round_up(n: Column, to: int) -> Column:
    return (F.floor((n + (to - 1)) / to) * to).cast("long")


def instance_size(primitive_bytes: Column, references: Column, word: int = 8, reference: int = 4, pointer: int = 4, align: int = 8) -> Column:
    """Header (a word and the class pointer), all fields of the class chain, rounded up."""
    return round_up(F.lit(word + pointer) + primitive_bytes + references * reference, align)


def array_size(length: Column, element: int, word: int = 8, pointer: int = 4, align: int = 8) -> Column:
    to = max(word, element)
    header = -(-(word + pointer + 4) // to) * to
    return round_up(F.lit(header) + length * element, align)
