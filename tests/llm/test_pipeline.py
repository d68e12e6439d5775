"""run() and its stages against plain Python, and odd tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from auditlake.llm import jaccard, pii, toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (copies, passages, personal data, toxic texts) and labels."""
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(90).collect()]
    passage = "a passage of far more than fifty bytes, with ü and 漢, that several documents share word by word"
    words = [f"w{k}" for k in np.random.default_rng(1).permutation(120)]
    given += [(5001, " ".join(words)), (5000, " ".join([*words[:-1], "changed"])), (5002, " ".join(words)), (5003, f"one {passage} end"), (5004, f"two {passage} other end, mail a.b@example.org or +1 202 555 0143 now"), (5005, None), (5006, ""), (5007, "4111 1111 1111 1111"), (5008, "x <|endoftext|> y")]
    draw = np.random.default_rng(2)
    prose = lambda n: ["v" + chr(97 + k // 20) + chr(97 + k % 20) for k in draw.integers(0, 400, n)]
    given += [(6000 + k, " ".join([*prose(8), "you", "blorkhead", *prose(8)])) for k in range(45)] + [(6100 + k, " ".join(prose(18))) for k in range(70)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 6100)) for i, _ in given if i >= 6000], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain_cut(rows):
    """Texts without the characters all of whose bytes are in a 50-byte string of a smaller doc_id."""
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - 49):
            least[raw[k : k + 50]] = min(i, least.get(raw[k : k + 50], i))
    out = []
    for (i, raw), (_, text) in zip(raws, rows, strict=True):
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, text if text is None else "".join(kept)))
    return out


def test_run_and_stages_against_plain_python(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{name}.parquet") for name in ("documents", "labels"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = toxicity.train(docs, labels)
    scorer = toxicity.ClauseScorer(model.lexicon)
    wanted = [[(i, t) for i, t in rows if model.score([scorer.features(t or "")])[0] < 0.3]]
    group = brute_components(wanted[-1], 5, 80)
    wanted.append([(i, t) for i, t in wanted[-1] if group[i][1] == i])
    wanted.append(plain_cut(wanted[-1]))
    masks = pii.find_spans([t or "" for _, t in wanted[-1]], pii.shipped())
    wanted.append([(i, t if t is None else pii.masked(t, every)) for (i, t), (_, every) in zip(wanted[-1], masks, strict=True)])
    assert len(wanted[0]) < len(rows) and len(wanted[1]) < len(wanted[0]) and all(a != b for a, b in zip(wanted[1:], wanted[2:], strict=False))
    kept = dict(wanted[-1])
    assert not any(6000 <= i < 6045 for i in kept) and all(i in kept for i in range(6100, 6170))
    assert {5000, 5003, 5004, 5005, 5006, 5007, 5008} <= set(kept) and not {5001, 5002} & set(kept)
    assert "[EMAIL]" in kept[5004] and "[PHONE]" in kept[5004] and "several documents share" not in kept[5004] and kept[5007] == "[CARD]"
    now = docs
    for (_, stage), after in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        made = stage(spark, now, corpus)
        assert made.columns == docs.columns and sorted((r.doc_id, r.text) for r in made.collect()) == after
        now = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in after], docs.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = set()
    for i, t in wanted[-1]:
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        lengths = [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]
        for n in lengths:
            pieces.add((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    got = corpus_pipeline.run(spark, corpus).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == pieces and len(got) == len(pieces)


def test_stages_on_odd_tables(spark, corpus):
    names = ["g", "key", "n", "id", "token", "row", "k", "text is null", "label", "score", "gone"]
    odd = [(1, "plain words here and more"), (2, None), (2, None), (3, ""), (4, "  \n\t "), (None, "no id at all"), (None, "no id at all"), (5, "äöü 漢字 🙂 " * 30), (6, "a" * 5000), (7, "plain words here again"), (7, "plain words here again"), (8, "x y " * 3000)]
    table = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, table, corpus)
        assert made.columns == table.columns
        once = [(2, None), (7, "plain words here again")]
        wanted = [r for r in odd if name != "near copies" or r not in once] + (once if name == "near copies" else [])
        assert sorted(((r.doc_id, r.text) for r in made.collect()), key=str) == sorted(wanted, key=str), name
        assert stage(spark, table.where("false"), corpus).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, corpus).select("doc_id").distinct().count() == 9
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "passages", "personal data", "packing"]


def test_stages_begin_with_slim_executors(spark, corpus, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "slim", lambda _: seen.append("stage"))
    monkeypatch.setattr(jaccard, "slim", lambda _: seen.append("join"))
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus)
    assert seen == ["stage", "join", "join", "stage", "stage", "stage"]
