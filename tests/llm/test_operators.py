"""Small tests of every operator: brute force, round trips, and odd inputs."""

import collections
import gc
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditlake.llm import bpe, common, jaccard, matroska, packing, pii, quality_rff, quality_rules, shingles, stats, suffixes, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, "plain words here"), (2, None), (3, ""), (4, "  \n\t "), (None, "no id at all"), (5, "äöü 漢字 🙂 " * 30), (6, "a" * 5000), (7, "plain words here"), (7, "plain words here"), (8, "x y " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, repeated rows, and extra columns with the operators' own names."""
    rows = [(*r, i, "n", 1.5) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, source string, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def test_bpe_equals_whole_text_encoding(spark, odd, none):
    whole = bpe.encoder(RANKS)
    got = bpe.round_trip(odd, RANKS).collect()
    assert len(got) == len(ODD)
    for (_, text), row in zip(ODD, got, strict=True):
        ids = whole.encode_ordinary(text or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()
    assert [bytes(r.text_bytes).decode() for r in back] == [t or "" for _, t in ODD]
    assert bpe.round_trip(none, RANKS).count() == 0


def test_safe_parts_keep_the_ids():
    text = "one  two\n three 's four's\t\tfive " * 40
    parts = bpe.safe_parts(text, 50)
    assert len(parts) > 5 and "".join(parts) == text
    whole = bpe.encoder(RANKS)
    assert [i for p in parts for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


def test_packing(odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(odd, TOKENIZER).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in rows)
    for doc_id, text in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = [r for r in rows if r.doc_id == doc_id][: len(packing.piece_lengths(len(ids)))]
        assert [r.start for r in own] == list(itertools.accumulate([0, *[r.length for r in own]]))[:-1]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids) for r in own)
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.pack(none, TOKENIZER).count() == 0


def test_matroska(odd, none):
    for mode, frames in (("xiph", [b"a" * 300, b"b", b"c" * 700]), ("ebml", [b"a" * 300, b"b" * 10, b"c" * 700, b"d"]), ("fixed", [b"xy"] * 4), ("none", [b"q"])):
        flags, body = matroska.lace(frames, mode)
        assert [body[s:e] for s, e in matroska.unlace(body, 0, len(body), flags)] == frames
    payload = matroska.padded(bytes(range(256)) * 700)
    media = matroska.mux(payload)
    table = matroska.parse(media)
    assert matroska.samples(media, table) == payload and len(table.cues) == len(table.clusters) > 1
    assert {c[2] for c in table.cues} == set(table.clusters)
    # Clusters of unknown size, and a block group.
    block = matroska.element(matroska.BLOCK, b"\x81\x00\x05\x00data")
    odd_one = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + matroska.unsigned(matroska.TIMESTAMP, 10) + matroska.element(matroska.BLOCK_GROUP, block) + b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + matroska.unsigned(matroska.TIMESTAMP, 20)
    read = matroska.parse(odd_one)
    assert [r[:2] for r in read.rows] == [(1, 15_000_000)] and len(read.clusters) == 2
    rows = matroska.store_texts(odd, keep_media=True)
    got = rows.collect()
    assert len(got) == len(ODD)
    for (_, text), r in zip(ODD, got, strict=True):
        raw = matroska.padded((text or "").encode())
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.payload_bytes == len(raw) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    packets = matroska.packet_table(rows.select(F.col("doc_id").alias("media_id"), F.when(F.col("doc_id") != 1, F.col("media")).alias("media")))
    assert packets.where("error is not null").count() == 2 and matroska.store_texts(none).count() == 0


def test_warc_round_trip_and_merge(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://www.a.de/x", "same"), (2, "http://b.de/", None), (3, "http://a.de/x#f", "same"), (4, None, ""), (4, None, ""), (5, "http://a.de/ü", "line\r\n\r\nline WARC/1.1\r\n"), (None, "http://c.de", "same")], "page_id long, url string, html string").repartition(3)
    got = warc.capture_histories(pages, str(tmp_path / "w")).collect()
    assert len(got) == 7
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].record_type, by_id[1].refers_to, by_id[3].record_type) == ("revisit", 3, "response")
    assert (by_id[2].refers_to, by_id[2].payload_bytes) == (4, 0) and by_id[5].payload_bytes == len(b"line\r\n\r\nline WARC/1.1\r\n")
    order = sorted(got, key=lambda r: (r.range_no, r.range_seq))
    keys = [(r.key, r.stamp) for r in order]
    assert keys == sorted(keys)
    empty = warc.capture_histories(pages.where("false"), str(tmp_path / "e"))
    assert empty.count() == 0


def test_loser_tree():
    r = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((int(v),) for v in r.integers(0, 50, int(r.integers(0, 20)))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain.from_iterable(runs))


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)]


def test_statistics(spark, sf_dir, odd, labels, none):
    texts = [t or "" for _, t in ODD] + ["a b c a b c", "l\nl\n \n \nl #|", "a a a a", "a b c d"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert stats.measure(text)[0] == brute_stats(text)
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_boosted_trees_are_monotone():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (600, 3))
    y = (x[:, 0] + 0.3 * np.sin(5 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + r.normal(0, 0.2, 600) > 0.2).astype(float)
    trees = quality_rules.fit(x, y, [1, 0, -1], rounds=30)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(x[:40], 30, axis=0)
    grid[:, 0] = np.tile(np.linspace(-1, 1, 30), 40)
    assert (np.diff(trees.margin(grid).reshape(40, 30), axis=1) >= -1e-12).all()
    assert quality_rules.fit(np.empty((0, 3)), np.empty(0), [0, 0, 0]).probability(x[:1])[0] == pytest.approx(0.5)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held(rows, labels, column, folds, fold):
    wanted = {r.doc_id: r[column] for r in labels.collect()}
    got = [(wanted[r.doc_id], r.score) for r in rows if r.doc_id in wanted and r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % folds == fold) == r.held_out for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    ones, zeros = [s for y, s in got if y], [s for y, s in got if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_quality_classifier(documents, odd, labels, none):
    docs, known = documents
    assert held(quality_rff.quality_scores(docs, known).collect(), known, "quality", 5, 0) > 0.95
    assert len(quality_rff.quality_scores(odd, labels).collect()) == len(ODD)
    assert {r.score for r in quality_rff.quality_scores(odd, labels.where("false")).collect()} == {0.5}
    assert quality_rff.quality_scores(none, labels).count() == 0
    at, rate = quality_rff.isotonic(np.arange(5.0), np.array([0, 3, 1, 4, 5.0]), np.full(5, 5.0))
    assert (np.diff(rate) >= 0).all() and len(at) == 4


def test_toxicity(spark, documents, odd, labels, none):
    docs, known = documents
    assert held(toxicity.toxicity(docs, known).collect(), known, "toxic", 4, 2) > 0.8  # 14 toxic documents are held out
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    assert held(toxicity.toxicity(docs, known).collect(), known, "toxic", 4, 2) > 0.94
    assert len(toxicity.toxicity(odd, labels).collect()) == len(ODD) and toxicity.toxicity(none, labels.where("false")).count() == 0
    scorer = toxicity.ClauseScorer(toxicity.Lexicon({"idiot": 4.0}, {"vequ": 3.0}))
    score = lambda text: sum(scorer.clauses(text)[0])
    assert score("you idiot") > score("an idiot here") > score("she said an idiot") > score("not an idiot") > score("a tree") == 0
    assert score("I will kill you") > 0 == score("kill the lights")
    assert score("the vequno") == 3.0 and score("vequ") == 0
    # Targets and reporting verbs count on either side, threats only with a target, and heaped insults more.
    assert score("idiot like you") == score("you idiot") and score("an idiot, she said") == score("she said an idiot")
    assert score("kill you") == score("you kill") > 0 and score("an idiot idiot here") == pytest.approx(4 + 5)
    assert score("never kill you") < score("kill you") and score("you said you kill") < score("you you kill")


def test_machines_equal_their_parts_in_turn():
    left, right = toxicity.grammar()
    r = np.random.default_rng(9)

    def run(machine, symbols):
        state, outs, weight = machine.start, [], 0.0
        for symbol in symbols:
            state, out, w = machine.step(state, symbol)
            outs.append(out)
            weight += w
        return outs, weight

    for _ in range(500):
        clause = list(r.choice(toxicity.ALPHABET, int(r.integers(0, 12))))
        wanted = clause
        for part in (toxicity.insult(), toxicity.negation(), toxicity.reported(), toxicity.targeted()):
            wanted, _ = run(part, wanted)
        assert run(left, clause)[0] == wanted
        back, total = wanted[::-1], 0.0
        for part in (toxicity.reported(), toxicity.targeted(), toxicity.threat(), toxicity.weigher()):
            back, weight = run(part, back)
            total += weight
        assert run(right, wanted[::-1]) == (back, pytest.approx(total))


def test_clean_documents(spark, documents, odd, labels, none):
    docs, known = documents
    scored = toxicity.toxicity(docs, known)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    bad = {r.doc_id for r in scored.where("predicted = 1").collect()}
    kept = toxicity.clean_documents(docs.withColumn("score", F.lit("x")), known)
    assert kept.columns == [*docs.columns, "score"] and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    assert toxicity.clean_documents(odd, labels.where("false")).count() == len(ODD) and toxicity.clean_documents(none, known).count() == 0


def test_removed_passages_against_brute_force(spark, documents, none):
    rows = [(r.doc_id, r.text) for r in documents[0].limit(150).collect()]
    shared = "this passage of more than fifty bytes is found in several documents, ü"
    rows += [(9001, "x" * 60 + shared), (9000, shared + "y" * 200), (9002, shared), (9002, shared), (9003, None), (9004, "y" * 120), (9005, "short")]
    seen: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            seen[raw[k : k + 50]] = min(i, seen.get(raw[k : k + 50], i))
    wanted = []
    for i, t in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen[raw[k : k + 50]] < i:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
        wanted.append((i, len(raw), sum(mask), sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1])), hashlib.sha256(kept).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffixes.removed_passages(docs).collect()) == sorted(wanted)
    cut = suffixes.without_passages(docs.withColumn("lang", F.lit("x")))
    assert cut.columns == ["doc_id", "text", "lang"] and cut.where("doc_id = 9003 and text is null").count() == 1 and cut.count() == len(rows)
    assert suffixes.removed_passages(none).count() == 0


def test_suffix_array():
    r = np.random.default_rng(2)
    for n, kinds in ((1, 2), (2, 1), (90, 1), (700, 2), (1500, 250)):
        data = r.integers(0, kinds, n).astype(np.uint8)
        order, raw = suffixes.suffix_array(data, 50), data.tobytes()
        keys = [raw[i : i + 50] for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        union = len(sets[a] | sets[b])
        if union and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * union:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join_against_brute_force(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents[0].limit(120).collect()]
    r = np.random.default_rng(3)
    base = rows[0][1].split()[:150]
    for k in range(25):
        words = list(base)
        for _ in range(int(r.integers(0, 7))):
            words[int(r.integers(len(words)))] = f"x{int(r.integers(40))}"
        rows.append((5000 + k, " ".join(words)))
    rows += [(7000, ""), (7001, None), (7002, "a b"), (7003, "A b"), (7004, "a  b\n"), (7005, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)


def test_jaccard_join_of_unlinked_copies(spark, monkeypatch):
    """Copies of one text, nearly all too far apart to link, are not compared in pairs."""
    r = np.random.default_rng(12)
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(200):
        words = list(base)
        for at in r.choice(150, 2, replace=False):
            words[at] = f"own{k}-{at}"
        rows.append((k, " ".join(words)))
        if k % 20 == 0:
            rows.append((1000 + k, " ".join([*words[:-1], "end"])))
    met, meeting = [], jaccard.JaccardJoin._meeting

    def counted(*given, **named):
        met.append((pairs := meeting(*given, **named)).count())
        return pairs

    monkeypatch.setattr(jaccard.JaccardJoin, "_meeting", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, 3, 90).collect()}
    assert got == brute_components(rows, 3, 90) and sum(met) < 10 * len(rows), met


def test_jaccard_join_moves_texts_of_candidates_only(spark, monkeypatch):
    """Texts that share a passage, but whose tokens by cell are too far apart, are neither stored nor dealt."""
    rows = []
    for k in range(40):
        common = [f"both{k}-{i}" for i in range(25)]
        rows += [(i, " ".join([*common, *(f"own{i}-{j}" for j in range(40))])) for i in (k, 1000 + k)]
    base = [f"w{i}" for i in range(200)]
    rows += [(500, " ".join(base)), (1500, " ".join([*base[:-1], "end"]))]
    texts, stored, dealt = [], jaccard.stored, jaccard.JaccardJoin._dealt

    def counted(made):
        if "text" in made.columns:
            texts.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "stored", lambda *given: counted(stored(*given)))
    monkeypatch.setattr(jaccard.JaccardJoin, "_dealt", lambda *given: counted(dealt(*given)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, 3, 90).collect()}
    assert got == brute_components(rows, 3, 90) and got[1500][1] == 500
    assert texts and sum(texts) < 10, texts


def test_tokens_by_cell(spark):
    """Counts by cell never differ by more than the sets, and tell long sets apart that have little in common."""
    r = np.random.default_rng(14)
    pairs = []
    for percent in (20, 60, 90):
        for n, kept in itertools.product((1, 30, 700, 1100, 9000), (0.0, 0.5, 0.95, 1.0)):
            one = r.integers(0, 1 << 64, n, dtype=np.uint64)
            other = np.concatenate([one[: int(n * kept)], r.integers(0, 1 << 64, int(r.integers(1, n + 20)), dtype=np.uint64)])
            pairs.append((percent, n, len(other), kept, len({*one.tolist()} ^ {*other.tolist()}), *(jaccard.by_cell(x, percent).tolist() for x in (one, other))))
    full = np.arange(40000, dtype=np.uint64)  # all in one cell
    pairs.append((90, 40000, 300, 0.0, 39700, *(jaccard.by_cell(x, 90).tolist() for x in (full, full[:300]))))
    made = spark.createDataFrame(pairs, "percent int, n int, m int, kept double, apart int, a array<int>, b array<int>")
    got = made.select("*", jaccard._apart("a", "b").alias("seen"), F.size("a").alias("a_cells"), F.size("b").alias("b_cells")).collect()
    assert all(0 <= x.seen <= x.apart for x in got) and any(x.a_cells > 2 * x.b_cells for x in got) and any(x.a_cells < x.b_cells for x in got)
    assert all(190 * x.seen > 10 * (x.n + x.m) for x in got if x.percent == 90 and x.n == 9000 and x.kept < 0.6)


def test_shared_at_least():
    """Every similar pair of which one is not similar to the leader shares as many tokens as both sides assume."""
    r = np.random.default_rng(13)
    for percent in (60, 80, 90):
        for _ in range(4000):
            pool = int(r.integers(3, 40))
            leader, one = ({*r.choice(pool + 2, pool, replace=False).tolist()} for _ in range(2))
            other = {t for t in one if r.random() < 0.95} | {*r.integers(0, pool + 4, int(r.integers(0, 3))).tolist()}
            similar = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
            if other and similar(one, other) and not (similar(one, leader) and similar(other, leader)):
                shared = len((one ^ leader) & (other ^ leader))
                assert all(1 <= jaccard.shared_at_least(len(x), len(x ^ leader), len(leader), not similar(x, leader), percent) <= shared for x in (one, other))


def test_shingles_against_plain_sets():
    draw = np.random.default_rng(10)
    made = ["", "a", "A b", "\n x\ty  z w", "é É ü ß", "x" * 9 + " " + "y" * 8 + " " + "z" * 7, "x" * 3000 + " b c", "x" * 3001 + " b c"]
    made += [" ".join(draw.choice(["a", "b", "ab", "abcdefgh", "abcdefghi", "漢"], int(draw.integers(0, 12)))) for _ in range(1500)]
    for words in (1, 3, 5):
        sets, by_tokens = shingles.Sets(pa.array(["skipped", *made]).slice(1), words), {}
        for i, text in enumerate(made):
            found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
            plain = frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1)) or (frozenset({tuple(found)}) if found else frozenset())
            assert len(sets[i]) == len(plain) and by_tokens.setdefault(plain, sets[i].tobytes()) == sets[i].tobytes()
        assert len(set(by_tokens.values())) == len(by_tokens) and sets.keys()[0] is None


def test_jaccard_join_of_odd_tables(spark, odd, none):
    table = odd.withColumns({c: F.lit(1) for c in ("g", "key", "n", "id", "token", "pos", "text_hash", "component")})
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table, 3, 90).collect())
    wanted = {i: c for i, c in brute_components([r for r in ODD if r[0] is not None], 3, 90).items()}
    assert got == sorted([(i or 0, *wanted.get(i, (2, None))) for i, _ in ODD])
    assert jaccard.jaccard_components(none, 3, 90).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_key_filter(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    rows = common.KeyFilter(keys, "k").marked(spark.range(-50, 4000).withColumn("k", F.col("id")), "k").collect()
    assert len(rows) == 4050 and all(r._filter_hit for r in rows if 0 <= r.k < 3000 and r.k % 3 == 0)
    assert sum(r._filter_hit for r in rows) < 1600 and common.KeyFilter(keys.where("false"), "k").possible(keys, "k").count() == 0


def test_key_filter_tests_the_bits_of_its_keys_without_text(spark):
    keys, rows = spark.range(0, 40000, 7).toDF("k"), spark.range(-5000, 60000).toDF("k")
    made = common.KeyFilter(keys, "k")
    place = F.pmod(F.xxhash64("k"), F.lit(made.size)).alias("p")
    expected = {r.k for r in rows.select("k", place).join(keys.select(place).distinct(), "p", "left_semi").collect()}
    found = made.possible(rows, "k")
    assert {r.k for r in found.collect()} == expected and len(expected) < 30000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_filter_words" in plan and "conv(" not in plan.partition("Join")[0]


def test_slim_gives_back_freed_heap(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    big = spark.sparkContext._gateway.new_array(spark._jvm.long, 200 << 20)
    grown = runtime.totalMemory()
    del big
    gc.collect()
    common.slim(spark)
    assert runtime.totalMemory() < grown - (400 << 20)


def test_jaccard_join_begins_with_slim_executors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "slim", seen.append)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert len(seen) == 2


def test_jaccard_join_of_repeated_ids(spark):
    r = np.random.default_rng(5)
    bases = [[f"{c}{k}" for k in r.permutation(60)] for c in "abcdef"]
    near = lambda c, k: " ".join([*bases[c][:-1], f"n{k}"])
    # 10: two texts of one size; 20: of two sizes; 30: one text is 5's; 40: words and none; 50: alone; 60: none twice.
    rows = [(10, near(0, 0)), (10, near(1, 0)), (11, near(0, 1)), (12, near(1, 1)), (13, near(1, 2)), (20, near(2, 0)), (20, near(3, 0) + " more words"), (21, near(2, 1)), (22, near(3, 1)), (5, near(4, 0)), (30, near(4, 0)), (30, near(5, 0)), (31, near(5, 1)), (40, ""), (40, near(4, 1)), (50, "quite another text that is alone"), (60, ""), (60, None), (None, near(0, 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((x.doc_id, x.n_shingles > 0, x.component_id) for x in jaccard.jaccard_components(docs, 3, 80).collect())
    groups = {5: (5, 30, 31, 40), 10: (10, 11, 12, 13), 20: (20, 21, 22), 50: (50,), 60: (60,)}
    component = {i: c for c, members in groups.items() for i in members} | {None: None}
    assert got == collections.Counter((i, bool(t), component[i]) for i, t in rows)
    kept = [jaccard.one_of_each(docs.repartition(k), 3, 80).collect() for k in (1, 4)]
    assert sorted(kept[0], key=str) == sorted(kept[1], key=str) and [*sorted(x.doc_id for x in kept[0] if x.doc_id is not None)] == [5, 10, 20, 50, 60] and len(kept[0]) == 6


def test_personal_data(odd, none):
    text = "mail a.b@c-d.example.com, ip 10.0.0.256 or 10.0.0.25, card 4111 1111 1111 1111 and +49 (30) 123-45678 end"
    spans = {(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)}
    assert spans == {("email", "a.b@c-d.example.com"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-45678")}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = np.random.default_rng(4)
    for _ in range(2000):
        text = "".join(r.choice(list("ab@.-1 +"), 14))
        assert [s[1:] for s in pii.base_spans(text) if s[0] == 0] == [m.span() for m in email.finditer(text)]
    assert pii.masked("x a@b.c y", [(0, 2, 7)]) == "x [EMAIL] y"
    net = pii.trained()
    writer, found, wanted = pii.SpanWriter(77), 0, 0
    for _ in range(60):
        text, tags = writer.window()
        got = pii.tag_texts(net, [text])[0]
        wanted += sum(t > 0 for t in tags)
        found += sum(g == t for g, t in zip(got, tags, strict=True) if t)
    assert found / wanted > 0.8
    # The file holds what the seeded training gives; another machine's last digits may differ.
    windows = [writer.window()[0] for _ in range(60)]
    same = [(a == b).mean() for a, b in zip(pii.tag_texts(net, windows), pii.tag_texts(pii.shipped(), windows), strict=True)]
    assert np.mean(same) > 0.97
    rows = pii.personal_data(odd, net).collect()
    assert len(rows) == len(ODD) and all(x.n_email == 0 for x in rows)
    assert pii.personal_data(none, net).count() == 0
    assert pii.mask_documents(odd, net).columns == odd.columns
    assert [(x.doc_id, x.text, x.score) for x in pii.mask_documents(odd, net).collect()] == [(i, t, 1.5) for i, t in ODD] and pii.mask_documents(none, net).count() == 0


def test_crf_gradient():
    net, writer = pii.Network.fresh(3), pii.SpanWriter(5)
    windows = [writer.window() for _ in range(2)]
    coded, tags = np.array([pii.codes(t)[:9] for t, _ in windows]), np.array([g[:9] for _, g in windows])
    _, grad = pii.loss_and_gradient(net, coded, tags)
    for name, at in (("wf", (3, 5)), ("wb", (20, 41)), ("trans", (0, 1)), ("out", (7, 2)), ("embed", (int(coded[0, 3]), 2))):
        value, losses = net.p[name][at], []
        for step in (1e-5, -1e-5):
            net.p[name][at] = value + step
            losses.append(pii.loss_and_gradient(net, coded, tags)[0])
        net.p[name][at] = value
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[name][at], abs=1e-6)


def test_a_worker_lets_go_of_what_other_operators_keep():
    from auditlake.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.encoder(path)
    list(common.trimmed(iter, "packing")(iter(())))
    assert packing.encoder(path) is encoder
    list(common.trimmed(iter)(iter(())))
    assert packing.encoder.cache_info().currsize == 0


def test_memory_of_window_keys():
    import tracemalloc

    data = np.random.default_rng(3).integers(97, 123, 1 << 20, np.uint8).tobytes()
    tracemalloc.start()
    runs = suffixes.Runs(data, np.array([len(data)]), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 22 * len(data), most / len(data)
    raw = np.frombuffer(data, np.uint8)
    at = suffixes.KEYS_AT_ONCE - 100
    key = suffixes._window_keys(raw[at : at + 249], 50)
    run = np.searchsorted(runs.first, np.arange(at, at + 200), side="right") - 1
    assert (runs.key[run] == key).all() and (runs.last[run] >= np.arange(at, at + 200)).all()
