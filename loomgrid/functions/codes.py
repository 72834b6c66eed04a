"""Area codes: cleaned, one trailing ``.0`` dropped, padded to five digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (those of Unicode, as Python strips them).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def area_code(raw: Column) -> Column:
    """The code of a raw value; null where it is null or only white space.

    ``lpad`` would cut longer codes, so it is used for short ones only. Most values are clean already; trimming by a list of
    characters is slow, so it is left to the others.
    """
    clean = F.btrim(raw, F.lit(WHITE_SPACE))
    cut = F.when(F.endswith(clean, F.lit(".0")), F.substring(clean, F.lit(1), F.length(clean) - 2)).otherwise(clean)
    padded = F.when(F.length(cut) < 5, F.lpad(cut, 5, "0")).otherwise(cut)
    return F.when(F.rlike(raw, F.lit(r"\A[0-9]{5,}\z")), raw).otherwise(F.when(F.length(clean) > 0, padded))


def area_code_sql(column: str) -> str:
    """The same as SQL text for the oracle engine."""
    clean = f"trim({column}, '{WHITE_SPACE}')"
    cut = f"(CASE WHEN ends_with({clean}, '.0') THEN left({clean}, length({clean}) - 2) ELSE {clean} END)"
    return f"(CASE WHEN length({clean}) > 0 THEN CASE WHEN length({cut}) < 5 THEN lpad({cut}, 5, '0') ELSE {cut} END END)"
