"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folio.llm.ann import nearest
from folio.llm.components import connected_components
from folio.llm.decontaminate import leak_pairs, without_leaks
from folio.llm.exact_repeats import exact_repeats
from folio.llm.language import identify_languages, learn_profiles, without_unknown
from folio.llm.near_dup import near_duplicates, without_near_duplicates
from folio.llm.pieces import decode_pieces, encode_pieces, piece_digest
from folio.llm.pii import pii_report, redact
from folio.llm.sharding import ShardStore, shard_report
from folio.llm.storage import new_path
from folio.llm.token_counts import token_counts
from folio.llm.url_filter import filter_captures, validity_intervals

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_in string, score double, pii string, leaks string, piece_ids string, r string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boil strange soup near an old stone bridge at dawn and nobody asks why it smells of pepper"
AUTRE = "le petit chat dort sur la table pendant que la pluie tombe doucement dehors et que les enfants jouent dans la cuisine avec leurs amis du quartier"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, PROSE, "en"), (2, PROSE, "en"), (3, None, "en"), (4, "", None), (5, PROSE.replace("pepper", "salt"), "en"), (6, AUTRE, "fr"), (6, AUTRE, "fr"), (None, AUTRE, "fr"),
        (7, "x" * 200_000, "en"), (8, "12 34 !!", "en"), (9, "mail a.b@c.de or +1 (269) 555-3296, card 4111 1111 1111 1111, ip 10.0.0.255 and 10.0.0.256", "en"), (10, AUTRE + " " + PROSE, None),
    ]
    return spark.createDataFrame([(i, t, lang, "s", 0, "a", 1.0, "b", "c", "d", "e") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    got = {r.doc_id: r for r in token_counts(docs, WORD).collect()}
    assert (got[3].n_bytes, got[3].n_tokens, got[4].n_tokens) == (0, 0, 0)
    assert got[7].n_bytes == 200_000 and got[7].over_limit and not got[1].over_limit
    assert token_counts(docs, WORD).count() == 12 and token_counts(empty, WORD).count() == 0


def test_languages(docs, empty):
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[8].lang_pred == "und" and got[8].score == 0.0
    assert got[6].lang_pred == "fr" and got[1].lang_pred == "en" and 0 < got[1].score <= 1
    assert identify_languages(empty).count() == 0
    odd = docs.sparkSession.createDataFrame([(i, t, "en") for i, t in enumerate(["😀😀😀 🎉", "𝟙𝟚", "漢字", "the fox"])], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify_languages(odd).orderBy("doc_id").collect()] == ["und", "und", "en", "en"]
    with pytest.raises(ValueError, match="distinct languages"):
        learn_profiles(docs, max_languages=1)
    kept = without_unknown(docs, 0.05)
    assert kept.columns == docs.columns and {3, 4, 8}.isdisjoint({r.doc_id for r in kept.select("doc_id").collect()})


def _without_repeats(pairs, window=100):
    seen, out = {}, {}
    for i, t in sorted(pairs):
        for s in range(len(t) - window + 1):
            seen.setdefault(t[s : s + window], (i, s))
    for i, t in sorted(pairs):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] < (i, s):
                gone[s : s + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_exact_repeats_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.choice(list(b"abcdefgh \xc3\xa9"[:9]), n)).decode()
    base = [letters(900) for _ in range(4)]
    texts = []
    for i in range(40):
        a, b = base[i % 4], base[(i + 1) % 4]
        cut, more = int(rng.integers(0, 700)), int(rng.integers(60, 400))
        texts.append((i * 3, a[:cut] + letters(int(rng.integers(0, 90))) + b[cut : cut + more] + a[-99:] + "é" * int(rng.integers(0, 150))))
    texts += [(500, "z" * 350), (501, None), (502, ""), (503, "q" * 99), (504, "q" * 100), (505, "q" * 101)]
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_repeats(df).collect()}
    assert got == _without_repeats([(i, (t or "").encode()) for i, t in texts])
    named = df.select(F.format_string("d%09d", "doc_id").alias("doc_id"), "text")
    assert {int(r.doc_id[1:]): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_repeats(named).collect()} == got
    odd = {r.doc_id: r for r in exact_repeats(docs).collect()}
    assert odd[2].n_removed == odd[1].n_bytes and odd[1].n_removed == 0 and odd[6].n_removed == 0 and odd[3].n_bytes == 0
    assert odd[7].n_removed == 199_999 and odd[7].n_spans == 1
    assert exact_repeats(docs).count() == 12 and exact_repeats(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got[2] == got[5] == got[1] == 1 and got[3] == 3 and got[4] == 4 and got[6] == 6 and got[10] == 10 and got[None] is None
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 6, 7, 8, 9, 10]
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    parent = list(range(300))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i in range(300):
        for j in range(i):
            if len(bags[i] & bags[j]) / len(bags[i] | bags[j]) >= 0.8:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i in range(300)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


BASE_RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def _base(text):
    out = []
    for o, (kind, pattern) in enumerate(BASE_RE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return hashlib.sha256(",".join(s for *_, s in sorted(out)).encode()).hexdigest()


def test_personal_data_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(9)
    bits = ["a.b@c.de", "x@y", "@", "é", "😀", "+1 (269) 555-3296", "+", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", " ", "_", "%", ".", "-", "7", "DE89 3704 0044 0532 0130 00", "call 269-555-3296", "q@w.er_t@y.ui"]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(1, 9))))) for i in range(400)]
    got = {r.doc_id: r for r in pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, t in rows if got[i].base_sha256 != _base(t)] == []
    nine = next(r for r in pii_report(docs).collect() if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 1, 1, 1)
    text = next(r.text for r in redact(docs).collect() if r.doc_id == 9)
    assert text == "mail <email> or <phone>, card <card>, ip <ip> and 10.0.0.256"
    assert redact(docs).columns == docs.columns and pii_report(empty).count() == 0
    iban = spark.createDataFrame([(1, "account DE89 3704 0044 0532 0130 00, ssn 123-45-6789"), (2, "DE88 3704 0044 0532 0130 00 123-45-6789")], "doc_id long, text string")
    assert [r.spans for r in pii_report(iban).orderBy("doc_id").collect()] == ["iban:8:35,ssn:41:52", ""]


def test_personal_data_in_long_texts(spark):
    numbers = " ,".join(str(10**12 + 7 * i) for i in range(100_000))
    mails = "é😀 ".join(f"write to u{i}@x.org or +1 269 555 {i:04d}, call 269-555-{i:04d}" for i in range(3000))
    df = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string")
    pii_report(df.limit(0)).collect()
    began = time.monotonic()
    got = {r.doc_id: r for r in pii_report(df).collect()}
    text = next(r.text for r in redact(df.filter("doc_id = 2")).collect())
    assert time.monotonic() - began < 30
    assert got[1].spans == "" and (got[2].n_email, got[2].n_phone) == (3000, 3000)
    assert got[2].base_sha256 == _base(mails) and got[2].spans.count("local_phone") == 3000
    assert text == "é😀 ".join("write to <email> or <phone>, call <local_phone>" for _ in range(3000))


def test_sharding(spark, docs, empty):
    rows = shard_report(docs).collect()
    assert len(rows) == 12 and {r.doc_id for r in rows} >= {1, 7, None} and sum(r.n_bytes for r in rows if r.doc_id == 3) == 0
    assert shard_report(empty).count() == 0
    store = ShardStore(spark, new_path(spark, "store"), target=1 << 20, fanout=4)
    for k in range(5):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    before = store.manifest()
    assert len(before.shards) == 5
    after = store.compact(keep_old=True)
    assert len(after.shards) == 1 and sorted(r.id for r in store.rows().collect()) == list(range(50))
    assert store.rows(before).count() == 50
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(before, before.schema, [])


def test_sharding_keeps_all_content_over_many_versions(spark, docs, monkeypatch):
    monkeypatch.setattr("folio.llm.sharding.FULL_EVERY", 5)
    store = ShardStore(spark, new_path(spark, "store"), target=40_000, fanout=2)
    plain = docs.drop("text_in")
    versions = []
    for _ in range(7):
        versions.append(store.append(plain.repartition(3)))
        versions.append(store.compact(keep_old=True))
    assert store.manifest() == versions[-1] and versions[-1].version > 10  # read across full and partial lists
    assert len(versions[-1].shards) < 21
    rows = lambda df: sorted(map(repr, df.select(*sorted(plain.columns)).collect()))
    assert rows(store.rows()) == sorted(rows(plain) * 7) and rows(store.rows(versions[0])) == rows(plain)
    listed = sorted((r.doc_id or 0, r.n_bytes) for r in shard_report(docs, target=2000, arrivals=3).collect())
    assert listed == sorted((r.doc_id or 0, len((r.text or "").encode())) for r in docs.collect())


def test_nearest(spark):
    rows = [(i, [float(i), 1.0], "c") for i in range(30)] + [(100, [0.0, 0.0], "z"), (200, None, "n"), (300, [1.0, None], "n"), (400, [float("nan"), 1.0], "n"), (None, [1.0, 1.0], "n"), (5, [5.0, 1.0], "again"), (600, [1.0, 2.0, 3.0], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = nearest(df, F.expr("vec_id % 10 = 0"), k=3).filter("query_id = 10").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(9, 1.0), (11, 1.0), (8, 2.0)]
    twice = nearest(df, F.expr("vec_id = 5"), k=2).orderBy("rank", "vec_id").collect()
    assert [(r.rank, r.vec_id, r.score) for r in twice] == [(1, 5, 0.0), (1, 5, 0.0), (2, 4, 1.0), (2, 4, 1.0)]
    assert nearest(df, F.expr("vec_id = 600")).count() == 0 and nearest(df.limit(0), F.lit(True)).count() == 0
    foreign = nearest(df, df.filter("vec_id = 10"), k=1).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in foreign] == [(10, 10, 0.0)]


def test_nearest_recall_over_several_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 24)) * 3
    x = np.concatenate([centres[rng.integers(0, 30, 2500)] + rng.standard_normal((2500, 24)), np.repeat(centres[:1], 200, axis=0), rng.standard_normal((300, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.expr("vec_id % 20 = 0"), k=10, block_rows=256).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted(found[q])
        assert [rank for rank, *_ in own] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-9 for _, s, v in own)
        assert [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own)
        hits += sum(s <= np.sort(d)[9] + 1e-9 for _, s, _ in own)
    assert hits / (10 * len(range(0, len(x), 20))) >= 0.9


def test_url_filter(spark):
    entries = spark.createDataFrame([("domain", "example.com", "block", "2024-01-10"), ("host", "good.example.com", "allow", "2024-01-01"), ("host", "good.example.com", "block", "2024-03-01"), ("prefix", "a.example.com/x", "allow", "2024-01-01"), (None, "q", "block", "2024-01-01"), ("host", "tie.org", "allow", "2024-01-01"), ("host", "tie.org", "block", "2024-01-01")], "kind string, pattern string, action string, valid_from string").withColumn("valid_from", F.col("valid_from").cast("date"))
    rows = [(1, "https://a.Example.com/x/y?q", "2024-02-01"), (2, "http://a.example.com/xy", "2024-02-01"), (3, "http://a.example.com/", "2024-01-09"), (4, "https://u:p@good.example.com:80/", "2024-02-01"), (5, "https://good.example.com", "2024-03-01"), (6, None, "2024-02-01"), (7, "nonsense", "2024-02-01"), (8, "http://tie.org", "2024-02-01"), (9, "http://example.com", None), (None, "http://example.com", "2024-02-01"), (2, "http://a.example.com/xy", "2024-02-01")]
    caps = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, fetched string, kind string").withColumn("fetched", F.col("fetched").cast("date"))
    got = {r.page_id: (r.blocked, r.rule_kind) for r in filter_captures(caps, entries).collect()}
    assert got == {1: (False, "prefix"), 2: (True, "domain"), 3: (False, None), 4: (False, "host"), 5: (True, "host"), 6: (False, None), 7: (False, None), 8: (True, "host"), 9: (False, None), None: (True, "domain")}
    assert filter_captures(caps, entries).count() == 10 and filter_captures(caps, entries.limit(0)).filter("blocked").count() == 0
    assert validity_intervals(entries).filter("pattern = 'good.example.com' and valid_to is not null").count() == 1


def test_pieces(docs, empty):
    encoded = encode_pieces(docs, PIECE, check_col="score")
    rows = {r.doc_id: r for r in decode_pieces(encoded, PIECE, out_col="pii").collect()}
    assert rows[3].piece_ids is None and rows[3].score is None and rows[4].piece_ids == [] and rows[1].pii == PROSE and rows[7].score
    assert all(r.round_trip for r in piece_digest(docs, PIECE).collect()) and piece_digest(empty, PIECE).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "while seven wizards boil strange soup near an old bridge"), (2, None), (3, "wizards"), (5, "izards"), (None, PROSE), (4, "Seven WIZARDS, boil strange soup near; an old stone"), (4, "Seven WIZARDS, boil strange soup near; an old stone"), (6, "!!")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in leak_pairs(docs, bench).collect())
    assert got == [(d, i, 0) for d in (1, 2, 5, 10) for i in (3, 4)]
    wide = leak_pairs(docs, bench, error_rate=0.15, block_bytes=100).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in wide) == sorted((d, i, n) for d in (1, 2, 5, 10) for i, n in ((1, 5), (3, 0), (4, 0)))
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 8
    assert leak_pairs(empty, bench).count() == 0 and leak_pairs(docs, bench.limit(0)).count() == 0
    named = bench.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text")
    assert {r.item_id for r in leak_pairs(docs, named).collect()} == {"i3", "i4"}
    long = spark.createDataFrame([(1, ("lorem ipsum " * 40_000 + "seven wizards boil strange soup near an old stone ") * 3)], "doc_id long, text string")
    assert [(r.item_id, r.distance) for r in leak_pairs(long, bench).orderBy("item_id").collect()] == [(3, 0), (4, 0)]
