"""Queries over tables made here, with cases that the test tables do not have."""

import re
import unicodedata

import duckdb

from gridscribe.functions import text as T
from gridscribe.plans.catalogue import ORACLES, QUERIES


def both(spark, folder, name, tables):
    """Rows of a query over tables made here, held against those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=repr)
    assert got == sorted(con.execute(ORACLES[name]).fetchall(), key=repr)
    return got


def test_join_wrapped_lines(spark, tmp_path):
    def fold(text):
        out = ""
        for w in re.split("[\t-\r ]+", text):
            if w := w.strip("\t\n\v\f\r \xa0"):
                small = len(w) < 3 and all(unicodedata.category(c) == "Ll" for c in w)
                piece = small and (w not in T.ONE_LETTER if len(w) == 1 else not set(w) & set(T.VOWELS))
                out += w if piece and unicodedata.category(out[-1:] or " ")[0] == "L" else f" {w}" if out else w
        return out

    texts = ["Thành phố Hồ Chí Min h 1 t a", "a b\tc\n\nd", "  nh ng 5 h x. h é h", "Văn bả n\u00a0 \u00a0 số g", "de la casa of", "", " ", "x" * 9 + " ng" * 5000, None]
    got = dict(both(spark, tmp_path, "join_wrapped_lines", {"documents": spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")}))
    assert got == {k: None if t is None else fold(t) for k, t in enumerate(texts)}
    assert got[0] == "Thành phố Hồ Chí Minh 1 t a"


def test_flatten_positioned_pages(spark, tmp_path):
    """Three pages, a last page of one row, and a full page."""
    rows = [(k, f"Firm {k}", nation) for nation, n in ((0, 70), (1, 31), (2, 30)) for k in range(nation * 100, nation * 100 + n)]
    got = both(spark, tmp_path, "flatten_positioned_pages", {"supplier": spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey long")})
    assert len(got) == 131
