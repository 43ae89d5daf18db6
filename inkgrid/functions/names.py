"""File names and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The report's fields, in order.
REPORT_FIELDS = (
    "image", "size", "placement", "status", "output", "widthCM", "heightCM", "widthPX", "heightPX", "dpi", "coveragePercent", "colorML", "whiteML", "cost", "whiteOutput", "error",
)


def safe_name(name: Column) -> Column:
    """A file's name without its extension and with _ for what file systems forbid, at most 80 characters; `imagen` if nothing is left."""
    x = F.regexp_replace(name, r"\.[^.]+$", "")
    x = F.regexp_replace(x, r'[<>:"/\\|?*\x00-\x1f]', "_")
    x = F.substring(F.regexp_replace(x, r"[. ]+$", ""), 1, 80)
    return F.when(x == "", "imagen").otherwise(x)


def output_name(index: Column, name: Column, size: Column, placement: Column) -> Column:
    number = F.when(index + 1 < 1000, F.lpad((index + 1).cast("string"), 3, "0")).otherwise((index + 1).cast("string"))
    return F.concat(F.concat_ws("_", number, safe_name(name), size, placement), F.lit("_300ppp.png"))


def white_name(output: Column) -> Column:
    """The name of an output's white twin."""
    return F.regexp_replace(output, r"\.png$", "_blanco.png")


def csv_cell(value: Column, is_text: bool) -> Column:
    """A quoted report cell: quotes doubled, null empty, and text that a spreadsheet would take for a formula behind an apostrophe. Other values are numbers."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if is_text:
        text = F.when(text.rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
    else:
        text = F.regexp_replace(text, r"\.0$", "")  # whole numbers have no fraction
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(columns: list[tuple[Column, bool]]) -> Column:
    return F.concat_ws(",", *(csv_cell(c, t) for c, t in columns))
