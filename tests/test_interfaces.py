"""Prompt, command line, files, streams, and rows that ids don't tell apart."""

import io
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodos.__main__ import main
from lodos.operators import analysis, entities, grammar, keywords, morphology, readability, style, text_tables
from lodos.sources import files
from lodos.streaming import texts


def test_rows_stay_apart(spark):
    """Two equal rows with one id, a null id, a null and an empty text."""
    text = "Ali eve geldi. Okul güzel. Ankara çok büyük!"
    rows = [(1, text), (1, text), (None, "Veli 500 TL verdi. bir çok kitap"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ids = Counter(r[0] for r in rows)
    lexicon = morphology.seed_lexicon(spark)
    per_row = {
        "readability": readability.statistics(docs),
        "rhythm": style.rhythm(docs),
        "audit": style.audit(docs, docs.select(F.lit("geldi").alias("word"))),
        "corrected": grammar.corrected(docs, lexicon),
        "summaries": keywords.summaries(docs),
    }
    for name, out in per_row.items():
        assert Counter(r["doc_id"] for r in out.collect()) == ids, name
    assert {(r["doc_id"], r["sentences"]) for r in style.rhythm(docs).collect()} == {(1, 3), (None, 2), (2, 0), (3, 0)}
    assert [r["predicates"] for r in per_row["audit"].where("doc_id = 1").collect()] == [1, 1]
    assert {r["corrected"] for r in per_row["corrected"].where("doc_id is null").collect()} == {"Veli 500 TL verdi. birçok kitap"}
    placed = text_tables.placed_tokens(docs, "doc_id").where("doc_id = 1").collect()
    assert Counter((r["token"], r["start"]) for r in placed)["Ali", 0] == 2 and all(text[r["start"] : r["end"]] == r["token"] for r in placed)
    assert [r["text"] for r in text_tables.sentences(docs, "doc_id").where("doc_id = 1 and sentence = 1").collect()] == ["Okul güzel."] * 2
    assert {r["summary"][0] for r in per_row["summaries"].where("doc_id = 1").collect()} == {"Ali eve geldi."}
    assert Counter(r["keyword"] for r in keywords.keywords(docs).where("doc_id = 1").collect())["ali eve geldi"] == 2
    found = entities.entities(docs, spark.createDataFrame([("veli",), ("ali",)], "word string")).collect()
    assert Counter((r["doc_id"], r["label"], r["text"]) for r in found) == {(1, "PER", "Ali"): 2, (None, "PER", "Veli"): 1, (None, "MONEY", "500 TL"): 1}
    assert Counter((r["doc_id"], r["text"]) for r in analysis.analyzed(docs, lexicon).collect())[1, "Okul güzel."] == 2


def test_offsets_of_long_texts(spark):
    words = [f"w{i} " + "," * (i % 3) for i in range(3000)]
    text = "  ".join(words)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = text_tables.placed_tokens(docs, "doc_id").collect()
    assert len(rows) == 9000 and all(text[r["start"] : r["end"]] == r["token"] for r in rows)


def test_cliches_and_prompt(spark):
    text = "Bu bağlamda konu kritik bir rol oynamaktadır. Süreç önemli bir adım; ancak sadece hız değil, aynı zamanda güven arar."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = style.cliches(docs).collect()
    assert all(text[r["start"] : r["end"]] == r["text"] and r["advice"] for r in found)
    assert {("BureaucraticConnector", "Bu bağlamda"), ("ConclusionHedge", "kritik bir rol oynamaktadır"), ("SemicolonConjunction", "; ancak"), ("IndefiniteArticleInflation", "önemli bir adım")} <= {(r["category"], r["text"]) for r in found}
    prompts = {r["doc_id"]: r["prompt"] for r in style.rewriting_prompt(docs, "akademik").collect()}
    assert prompts[2] is None and all(x in prompts[1] for x in ("Akademik-Kurumsal", "1. **Yüklem Çeşitliliği:** Metindeki 1 adet", "2. **Kalıp ve Klişe Temizliği:**", text))


@pytest.mark.parametrize(
    ("args", "field", "value"),
    [
        (["syllabify", "araba"], "syllables", ["a", "ra", "ba"]),
        (["number", "1923"], "words", "bin dokuz yüz yirmi üç"),
        (["asciify", "Türkçe Işık"], "folded", "Turkce Isik"),
        (["deasciify", "cok guzel"], "changed", "çok güzel"),
        (["normalize", "noldu"], "changed", "ne oldu"),
        (["generate", "kitap", "--tags", "P1sg,Dat"], "surface", "kitabıma"),
        (["stem", "kitaplarımızdan"], "stem", "kitap"),
        (["spellcheck", "kitab"], "suggestion", "kitap"),
        (["correct", "Evi terketmek zor."], "corrected", "Evi terk etmek zor."),
    ],
)
def test_commands(spark, args, field, value):
    out = io.StringIO()
    assert main(args, spark, out) == 0
    assert json.loads(out.getvalue().splitlines()[0])[field] == value


def test_every_command_answers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ali eve geldi.\nAyşe 500 TL verdi.", encoding="utf-8")
    for name in ("tokenize", "parse", "readability", "ner", "keywords", "summarize", "ai-audit", "humanize-prompt", "analyze", "syntactic-analyze", "grammar"):
        out = io.StringIO()
        arg = ["geldi"] if "analyze" in name else ["yada"] if name == "grammar" else ["-f", str(tmp_path)]
        main([name, *arg], spark, out)
        assert out.getvalue(), name


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Güzel kitabı okudu.\nBitti.", encoding="utf-8")
    docs = files.text_files(spark, str(tmp_path / "in"))
    assert [r["text"] for r in docs.collect()] == ["Güzel kitabı okudu.\nBitti."]
    files.write_conllu(morphology.conllu(morphology.disambiguated(docs, morphology.seed_lexicon(spark))), str(tmp_path / "conllu"))
    lines = [x for p in sorted((tmp_path / "conllu").glob("part*")) for x in p.read_text(encoding="utf-8").split("\n")]
    assert lines[0].startswith("# sent_id") and lines[1].split("\t")[:4] == ["1", "Güzel", "güzel", "ADJ"] and "" in lines
    files.write_json(docs.select("doc_id", F.lit(None).cast("string").alias("x")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).columns == ["doc_id"] or spark.read.json(str(tmp_path / "json")).count() == 1
    (tmp_path / "lex.txt").write_text("# own\nkuvars kuvars Noun\nblokzincir blokzincir Noun\n", encoding="utf-8")
    own = morphology.lexicon_lines(spark, str(tmp_path / "lex.txt"))
    assert [(r["root"], r["ord"]) for r in own.orderBy("ord").collect()] == [("kuvars", 1), ("blokzincir", 2)]


def test_streams(spark, tmp_path):
    rows = [(i, f"Bu bağlamda {i}. konu!", f"2026-01-01 00:{i:02d}:00") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, t string").selectExpr("doc_id", "text", "to_timestamp(t) AS at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    for name, out, mode in (("counts", texts.token_counts(stream), "append"), ("audits", texts.style_audits(stream), "append"), ("windows", texts.windowed_tokens(stream, "at"), "complete")):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    assert {r["n"] for r in spark.table("counts").collect()} == {6}
    assert spark.table("audits").count() == 30
    assert spark.table("windows").where("token_type = 'Word'").agg({"n": "sum"}).first()[0] == 90
