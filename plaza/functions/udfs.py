"""Functions that no built-in expression covers, on Arrow batches."""

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def nfc(s: pd.Series) -> pd.Series:
    """Composed Unicode without control characters other than tab and line end."""
    return s.str.normalize("NFC").str.replace(r"[\x00-\x08\x0b-\x1f]", "", regex=True)
