import math

import pandas as pd

SF_SMALL = "/root/testdata/sf0.001"


def norm(df: pd.DataFrame) -> list[tuple]:
    """Order-insensitive, column-name-sorted, 6-decimal normal form."""
    df = df[sorted(df.columns)]
    rows = []
    for rec in df.itertuples(index=False):
        out = []
        for v in rec:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                out.append("∅")
            elif isinstance(v, bool):
                out.append(str(v))
            elif isinstance(v, float):
                out.append(f"{round(v, 6):.6f}")
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)
