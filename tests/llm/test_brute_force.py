"""Queries whose results SQL cannot express, against brute force over small tables."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folio.llm import queries
from folio.llm.decontaminate import leak_pairs
from folio.llm.language import identify_languages, letter_codes, letter_vectors
from folio.llm.near_dup import near_duplicates
from folio.llm.shingles import normalised

DATA = "/root/testdata/sf0.01"


def _vector(text):
    letters, codes = letter_vectors().astype(float), letter_codes()
    line = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text).split())} "
    place = [0 if c == " " else int(codes[ord(c)]) for c in line]
    return sum((letters[0, a] * letters[1, b] * letters[2, c] for a, b, c in zip(place, place[1:], place[2:], strict=False)), np.zeros(letters.shape[2]))


def test_languages(spark):
    rnd = random.Random(5)
    words = {"en": "the and of house river stone with from night over".split(), "fr": "le et la maison rivière pierre avec depuis nuit sur".split(), "ru": "дом река камень ночь над под из свет день и".split()}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 40))), lang if i % 5 else None) for i, lang in enumerate(rnd.choices(list(words), k=120))] + [(500, "123", "en"), (501, None, "fr"), (502, "", None)]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    total = defaultdict(lambda: np.zeros(letter_vectors().shape[2]))
    for i, text, lang in rows:
        if text and lang and not held[i]:
            total[lang] += unit(_vector(text))
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        v = _vector(text or "")
        assert got[i].held_out == held[i]
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = {lang: float(unit(v) @ unit(p)) for lang, p in total.items()}
        best = max(cosine.values())
        assert cosine[got[i].lang_pred] >= best - 1e-5 and abs(got[i].score - min(1, max(0, best))) < 1e-5


def _nearest_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 9, 14])))) for i in range(12)]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(12))
        if i % 2:
            part = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 5)):
                part[rnd.randrange(len(part))] = rnd.choice("abcde ")
            text += " " + "".join(part) + " " + " ".join(word() for _ in range(8))
        docs.append((i, text))
    want = set()
    for i, text in docs:
        text = normalised(text).decode()
        for k, item in items:
            item = normalised(item).decode()
            if len(item) < 24:
                if f" {item} " in f" {text} ":
                    want.add((i, k, 0))
            elif (d := _nearest_substring(item, text)) <= int(0.1 * len(item)):
                want.add((i, k, d))
    found = leak_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), error_rate=0.1)
    assert {tuple(r) for r in found.collect()} == want and len({d for *_, d in want}) > 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_near_duplicates_of_a_whole_table(spark):
    texts = {r.doc_id: normalised(r.text).split() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in texts.items() if w}
    size = {i: sum(b.values()) for i, b in bags.items()}
    owners = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            owners[s].append(i)
    shared = Counter()
    for s, ids in owners.items():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += min(bags[a][s], bags[b][s])
    parent = {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n / (size[a] + size[b] - n) >= 0.8:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == {i: top(i) for i in texts} and len(set(got.values())) < len(got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_sharding_lists_every_document(spark):
    got = sorted((r.doc_id, r.n_bytes) for r in queries.op6_sharding(spark, DATA).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode())) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
