"""Queries against their SQL on rows that the supplied small tables don't have."""

import pyarrow as pa
import pyarrow.parquet as pq

from marlpit import catalogue
from oracle import agree


def test_chapters_keep_titles_as_proposed(spark, tmp_path):
    said = ["One.\nTwo three", "x" * 300 + " y", "", "\tTab word", " blank first", "  x", "a b", None]
    rows = [(c, t, "user" if t != 1 else "assistant", said[(t + c) % 8]) for c in range(8) for t in range(40)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))), tmp_path / "conversations.parquet")
    agree(spark, catalogue.QUERIES["chapters"], catalogue.ORACLE_SQL["chapters"], str(tmp_path))


def test_covers_have_one_capital_for_a_character(spark, tmp_path):
    titles = ["sße x", "a ßb", "ß", "ﬁn", "ᾳ ŉ", "ǳa", "\U00010428b c", "plain words", "", "ᾀὐ", "ı i"]
    n = len(titles)
    docs = {"doc_id": list(range(n)), "text": [f"{t}\nrest" for t in titles], "lang": ["de"] * n, "source": ["src1"] * n, "n_chars": [9] * n}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    agree(spark, catalogue.QUERIES["covers"], catalogue.ORACLE_SQL["covers"], str(tmp_path))
