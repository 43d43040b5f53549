"""Cell clean-up for spreadsheet exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.functions.columns import ref

# Fixed values of the spreadsheet format.
MAX_ROWS = 1_048_576  # header included
MAX_COLUMNS = 16_384
MAX_CELL_CHARS = 32_767
# Control characters a worksheet may not hold: all of C0 but tab, LF and CR.
FORBIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

_TYPED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def excel_safe_text(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, FORBIDDEN, ""), 1, MAX_CELL_CHARS)


def excel_safe(df: DataFrame) -> DataFrame:
    """Typed cells as they are, everything else as text a worksheet accepts."""
    return df.select(
        *(
            ref(f.name)
            if isinstance(f.dataType, _TYPED)
            else excel_safe_text(ref(f.name).cast("string")).alias(f.name)
            for f in df.schema.fields
        )
    )
