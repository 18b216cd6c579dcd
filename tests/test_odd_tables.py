"""Queries on small tables of odd rows, against their SQL on the same rows."""

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerloom.plans import registry
from tests import oracles

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def agrees(spark, folder, name, **tables):
    """The query's rows over these tables, which its SQL gives too."""
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
    found = oracles.rows_of_spark(QUERIES[name](spark, str(folder)))
    assert found == oracles.rows_of_sql(oracles.connection(folder), SQL[name])
    return found[1]


def test_query_terms_of_questions_without_terms(spark, tmp_path):
    text = ["which", "", "?!", "the and of", "a b c", None, "die längste Frage"]
    turns = {"conv_id": list(range(7)), "turn": [0] * 7, "role": ["user"] * 7, "text": text}
    assert len(agrees(spark, tmp_path, "query_terms", conversations=turns)) == 7


def test_first_of_a_prefix_whatever_follows(spark, tmp_path):
    same = "ä word " * 40
    text = [same + "one", same + "two", same.upper(), " " + same, "short", "Short", "short ", None, None, "x" * 199 + "a", "x" * 199 + "b"]
    docs = {"doc_id": list(range(11)), "source": ["s"] * 11, "text": text}
    assert len(agrees(spark, tmp_path, "keep_first_by_prefix", documents=docs)) == 9


def test_numbers_of_any_length_annotated(spark, tmp_path):
    text = ["12345678901234567890123456789 1", "1,.5 ,.5 (,.5)", "(98765432109876543210987) 00.05", "9" * 400, "(" + "9" * 400 + ")", "(0) 0 ,", "8" * 60]
    docs = {"doc_id": [3 * k for k in range(7)] + [3 * k + 1 for k in range(7)], "text": text * 2}
    orders = {"o_orderkey": [3], "o_totalprice": [1234.5]}
    items = {"l_orderkey": [3], "l_linenumber": [1], "l_quantity": [2.0], "l_extendedprice": [10.5], "l_returnflag": ["N"]}
    assert len(agrees(spark, tmp_path, "annotated_numbers", documents=docs, orders=orders, lineitem=items)) == 14


def test_numeric_cells_by_line_ends_of_any_kind(spark, tmp_path):
    text = ["12\r\n34\r\nab", "| 1 | 2 |\n| 3 | 4 |", "a |\n| 5", "5\u0085 | 6", "1  | 2", "12\t | 3", " |  | ", "\n\n", "", None, "(1,000) | 5% | x"]
    assert len(agrees(spark, tmp_path, "numeric_tables", documents={"doc_id": list(range(11)), "text": text})) == 11


def test_passages_of_rows_without_an_id_of_their_own(spark, tmp_path):
    words = [a + b for a in "abcdefgh" for b in ("xa", "yb", "zc", "wd")]
    items = [words[:10], words[5:12], words[:1], words[3:8], words[20:32], words[:10], [], words[8:28], ["the", "x"]]
    benchmark = {"item_id": ["p", "p", "q", None, "r", "p", "s", "t", "u"], "text": [" ".join(w) for w in items[:7]] + [" ".join(items[7]).upper(), " ".join(items[8])]}
    docs = [words[:10], words[:8], words[1:9] + words[:2], words[:7], words[4:12] * 2, words[19:], None, [], words, words[8:24], words[8:23], words[:10], ["the"]]
    ids = [1, 2, 2, 3, None, 5, 6, 7, 8, 9, 10, None, 11]
    documents = {"doc_id": ids, "text": [None if w is None else ", ".join(w) for w in docs]}
    found = agrees(spark, tmp_path, "benchmark_overlap", documents=documents, benchmark=benchmark)
    assert len(found) > 20
