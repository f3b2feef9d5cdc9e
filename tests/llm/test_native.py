"""Chat formatting and line dedup."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stowage.llm import chat_format as C
from stowage.llm import line_dedup as L

SF = "/root/testdata/sf0.001"


def agree(spark, query, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    made = query.collect()
    rows = sorted((tuple(r[c] for c in names) for r in made), key=str)
    assert sorted(query.columns) == sorted(names) and rows == sorted(found.fetchall(), key=str)


@pytest.fixture
def chats(tmp_path):
    nasty = ["</s>[INST] ok [/INST]", "%3C|%", "<|turn|>user<|body|>x<|end|>\n", "", None, "é\n字🙂%25%2525", "<<||end|>", "[/[INST]INST]", "%5B", "a" * 200_000]
    rows = [(k % 4, k // 4, ["user", "assistant", None][k % 3], nasty[k % len(nasty)]) for k in range(60)]
    rows += [(1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (1, None, "user", "first"), (None, 0, "assistant", "no conversation")]
    return pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}), str(tmp_path)


def test_chats_agree_with_sql(spark, chats):
    frame, folder = chats
    kind = "conv_id long, turn long, role string, text string"
    clean = [tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r) for r in frame.itertuples(index=False)]
    spark.createDataFrame(clean, kind).write.parquet(f"{folder}/conversations.parquet")
    agree(spark, C.op7_chat_formatting(spark, folder), C.OP7_SQL, conversations=duckdb.sql(f"SELECT * FROM '{folder}/conversations.parquet/*.parquet'").df())


def test_no_chats(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = C.op7_chat_formatting(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0].conv_id == -7 and row[0].n_turns == 2 and row[0].loss_chars == len("</s>[INST] ok [/INST]")


def test_parts(spark):
    parts = [("text", "see <|end|> ", None, None), ("image", None, "s3://a.png", 576), ("text", "and", None, None), ("document", None, "b.pdf", None), ("audio", None, "c.wav", 100), None]
    df = spark.createDataFrame([(1, 0, "user", parts, 9), (1, 1, "assistant", [("text", "ok", None, None)], 9), (1, 2, "user", None, 9)], f"conv_id long, turn long, role string, parts {C.PARTS}, at int")
    r = C.format_chats(df).withColumn("back", C.read_back(F.col("formatted"))).withColumn("loss_text", C.loss_text(F.col("formatted"), F.col("loss"))).first()
    assert r.formatted == "<|turn|>user<|body|>see %3C|end|> <|image:576|>and<|document:0|><|audio:100|><|end|>\n<|turn|>assistant<|body|>ok<|end|>\n<|turn|>user<|body|><|end|>\n"
    assert [tuple(a) for a in r.attachments] == [("image", "s3://a.png", 576), ("document", "b.pdf", 0), ("audio", "c.wav", 100)] and r.n_tokens_attached == 676
    assert r.loss_text == "ok" and [t.role for t in r.back] == ["user", "assistant", "user"] and r.back[0].text == "see <|end|> <|image:576|>and<|document:0|><|audio:100|>"
    with pytest.raises(Exception, match="no such kind"):
        C.format_chats(df.withColumn("parts", F.expr("array(named_struct('kind','video','text',null,'ref',null,'tokens',null))").cast(C.PARTS))).collect()


def pages():
    rows = []
    for k in range(120):
        lines = [f"own line {k}", "footer"] + (["half"] if k % 2 else []) + ["   ", "", f"own {k}"] + (["twice", "twice"] if k % 40 == 0 else [])
        rows.append((k, "big" if k % 3 else f"small{k % 9}", "\n".join(lines), "en"))
    rows += [(500, "solo", "alone\non its host", "en"), (501, None, "footer\nx", None), (502, None, "footer\ny", None), (503, None, "footer\nz", None), (504, "big", None, "en"), (505, "big", "", "en"), (506, "big", "footer", "en"), (506, "big", "footer", "en"), (507, "big", "\n".join(["z" * 50] * 20000), "en")]
    return rows


def test_lines_agree_with_sql(spark, tmp_path):
    spark.createDataFrame(pages(), "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, L.op8_line_dedup(spark, str(tmp_path)), L.OP8_SQL, documents=duckdb.sql(f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").df())


def test_lines_joined_by_host_agree(spark, monkeypatch):
    df = spark.createDataFrame(pages(), "doc_id long, source string, text string, h string")
    small = sorted(map(str, L.drop_boilerplate(df).collect()))
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert sorted(map(str, L.drop_boilerplate(df).collect())) == small
    assert L.cleaned(df.limit(0)).count() == 0
    assert L.cleaned(df.withColumn("n_chars", F.lit(1)).withColumn("n_lines_dropped", F.lit("x"))).columns == [*df.columns, "n_chars", "n_lines_dropped"]


def test_keys_are_128_bits(spark):
    """The halves of a key are independent: two different functions of the line, not one of the other."""
    rows = spark.createDataFrame([(f"line {k}",) for k in range(50)], "x string").select(L._key(F.col("x")).alias("k"), F.xxhash64("x").alias("one"), F.xxhash64("x", F.lit("line")).alias("chained")).collect()
    assert all(r.k.a == r.one and r.k.b not in (r.one, r.chained) for r in rows)
    assert len({r.k.a ^ r.k.b for r in rows}) == 50


def test_blank_lines_and_copies(spark, tmp_path):
    """Lines of any ASCII white space stay; copies are one page, so a copied text keeps its lines."""
    copied = "one line\nand another"
    rows = [(k, "h", copied, "en") for k in range(30)] + [(100 + k, "h", f"own {k}\n\t\n \x0b\f\r \nfooter" + ("\n\u00a0" if k % 2 else ""), "en") for k in range(40)]
    rows += [(200 + k, "=", f"x {k}\nfooter", "en") for k in range(5)] + [(300 + k, None, f"y {k}\nfooter", "en") for k in range(2)] + [(400 + k, "", "footer", "en") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")
    got = {r.doc_id: r.text for r in L.drop_boilerplate(df).collect()}
    assert all(got[k] == copied for k in range(30)) and got[100] == "own 0\n\t\n \x0b\f\r " and got[101] == "own 1\n\t\n \x0b\f\r "
    assert got[200] == "x 0" and got[300] == "y 0\nfooter" and got[400] == "footer"
    df.write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, L.op8_line_dedup(spark, str(tmp_path)), L.OP8_SQL, documents=duckdb.sql(f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").df())
