"""Queries on small tables of odd documents against their SQL."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from oracle import connect, rows_of, sql_rows  # noqa: E402

from textloom.plans import catalog, corpus, scripts  # noqa: E402, F401


def documents(spark, folder, texts):
    """A folder with the table of these texts; the places of the list are the doc_ids."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts) if t != "-"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{folder}/documents.parquet")
    return str(folder)


def compared(spark, folder, name):
    columns, rows = rows_of(catalog.QUERIES[name](spark, folder))
    assert rows == sql_rows(connect(folder), catalog.ORACLES[name], columns)
    return rows


def test_logical_lines_of_odd_texts(spark, tmp_path):
    """White space at the ends of lines, empty lines and texts, marks of continuation in a text, other line ends."""
    odd = ["", "\n", "a \nb\t\n\nc", "a _\nb _\nc _\nd", "_\n _\n\t_", " \n \n \n ", "a\r\nb\r\nc", "a\x0bb\x0cc d\x85e\nf", None, "x'y\n(z\nü.", "\n" * 20]
    assert len(compared(spark, documents(spark, tmp_path, odd), "logical_lines")) == 19


def test_sync_of_a_file_with_equal_texts(spark, tmp_path):
    """Markup, pictures and code stand in several templates of a long script; each entry takes its own old one."""
    texts = ["\n".join(f"line {i} of {d}" for i in range(880)) for d in range(3)]
    rows = compared(spark, documents(spark, tmp_path, ["-", *texts]), "sync_exact")
    assert sum("<b></b>" in str(r) for r in rows) > 3
