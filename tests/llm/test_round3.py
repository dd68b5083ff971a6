"""Fill-in-middle, SimHash near-dedup and collocations against brute-force versions, and for odd input."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_llm import SCHEMA, odd_rows

from lodestrata.llm import fim, licenses, phrases, queries, secrets, simhash
from lodestrata.llm._common import work_folder

SF = "/root/testdata/sf0.001"
WS = "\x20\t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 AS n", "2 AS form", "3 AS row", "4 AS fp", "5 AS grp", "6 AS output", "7 AS label")


def texts_frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


# --- fill in the middle --------------------------------------------------------------------------------------------------


def brute_fim(doc, text, rate=50, first=80):
    text = text or ""
    units = re.findall(rf"[{WS}]*[^{WS}]+|[{WS}]+", text)
    digest = sha(f"42:{'' if doc is None else doc}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < first:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def made_texts():
    rng = random.Random(11)
    alphabet = ["a", "é", "😀", " ", "  ", "\t", "\n", "\r\n", "\x0b", "<", ">", "P", "<P", "S>", "<S>", "\xa0", " ", "\x1f", "word", "\\E", "\\Q"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 40))) for _ in range(600)] + ["<P>", "a<M>b", " ", "   \n", "a ", " a", "<P<S"]


@pytest.mark.parametrize(("rate", "first"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fim_is_the_list_of_units(spark, odd, rate, first):
    for df in (texts_frame(spark, made_texts()), odd):
        found = fim.fill_in_middle(df, keep=("doc_id", "text"), rate=rate, suffix_first=first)
        rows = found.select("*", fim.restored(found["output"], found["form"]).alias("again")).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text, rate, first)
            assert r.again == (r.text or "")


def test_fim_of_a_very_long_text(spark):
    text = "ab \t" * 2_000_000 + "x" * 1_000_000
    (row,) = fim.fill_in_middle(spark.createDataFrame([(5, text)], "doc_id long, text string"), rate=100).collect()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute_fim(5, text, 100)


def test_fim_sentinels_that_could_arise_at_a_border():
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "cc"), ("aa", "b", "c"), ("<P>", "P", "<M>"), ("", "b", "c"), ("a b", "c", "d")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.checked(bad)
    assert fim.checked(("<|p|>", "<|s|>", "<|m|>")[:3])


def test_fim_query(spark):
    rows = queries.op11_fill_in_middle(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        n, form, prefix, middle, output = brute_fim(r.doc_id, text[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(text[r.doc_id] or ""))
    assert len(rows) == len(text) and {r.form for r in rows} == {"plain", "psm", "spm"}


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rf"[^{WS}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, near):
    """The least node that links reach, by trying all pairs."""
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if near(x, y):
                a, b = sorted((find(x), find(y)))
                label[b] = a
    return {x: find(x) for x in nodes}


def brute_near(rows):
    fps = {(d, t): brute_fingerprint(t) for d, t in rows}
    ids = defaultdict(list)
    for (d, _), f in fps.items():
        if d is not None:
            ids[f].append(d)
    named = reach(sorted(ids), lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for f, root in named.items():
        least[root] = min(least.get(root, 1 << 62), min(ids[f]))
    return Counter((d, f"{fps[d, t]:016x}", least.get(named.get(fps[d, t]))) for d, t in rows)


def test_fingerprint_bits():
    for text in ["", None, " ", "A b", "a b c d", "x y z w " * 50, "É é 😀 \x00", *made_texts()[:200]]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def clusters(rng, n, spread):
    out = []
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, spread)):
            x = centre
            for _ in range(rng.randrange(0, 7)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("n", "spread"), [(1, 300), (200, 4), (8, 60), (3, 3)])
def test_links_in_one_meeting_place(n, spread):
    """Small and large groups, with and without sides: what links join is what all pairs join."""
    rng = random.Random(n)
    fps = clusters(rng, n, spread)
    values, group, pivots = np.array(fps, np.uint64), np.zeros(len(fps), np.int64), simhash.references()
    for side in (np.full(len(fps), -1), np.array([rng.randrange(2) for _ in fps])):
        a, b = simhash.linked(values, group, side, pivots)
        counts = {x: int(s) for x, s in zip(fps, side, strict=True)}
        near = lambda x, y: (x ^ y).bit_count() <= 4 and (counts[x] < 0 or counts[x] != counts[y])  # noqa: B023, E731
        found = {(fps[i], fps[j]) for i, j in zip(a, b, strict=True)}
        assert all(near(x, y) for x, y in found)
        assert reach(fps, lambda x, y: (x, y) in found or (y, x) in found) == reach(fps, near)  # noqa: B023


@pytest.mark.parametrize(("cell", "r"), [(4096, 1), (30, 1), (4096, 2), (4096, 3)])
def test_links_of_a_table(spark, monkeypatch, cell, r):
    """All meeting places together, crowded ones in slices, and finer choices of blocks."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, d=4: r)
    fps = clusters(random.Random(cell + r), 12, 160)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), work_folder(spark)).collect()
    links = {(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in found}
    assert reach(fps, lambda x, y: (x, y) in links or (y, x) in links) == reach(fps, lambda x, y: (x ^ y).bit_count() <= 4)


def test_pivots_discard_only_what_is_far():
    rng = random.Random(5)
    fps = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    table = simhash.distance_table(fps, simhash.references())
    a, b = np.triu_indices(400, 1)
    left = simhash.survivors(table, a, b)
    close = np.bitwise_count(fps[a] ^ fps[b]) <= 4
    assert set(np.flatnonzero(close)) <= set(left) and len(left) < len(a) / 1000


def test_blocks_grow_with_the_table():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**7, 10**9, 10**12)] == [1, 1, 2, 3, 4]
    assert [len(simhash.masks(r)) for r in (1, 2, 3)] == [5, 15, 35]


def test_near_duplicates(spark, odd):
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randrange(1, 200))) for _ in range(40)]
    texts = base + [t + " more" for t in base[:20]] + [t.upper() for t in base[:10]] + base[:5] + [None, "", " "]
    for df in (texts_frame(spark, texts), odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == brute_near(rows)
    assert simhash.near_duplicates(odd.filter("1 = 0")).count() == 0


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op12_simhash(spark, SF).collect())) == brute_near(rows)


# --- collocations ---------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, longest=5, top=2000, share=100):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(13)
    words = ["The", "the", "cat", "é😀", "sat", "on", "a\x00b", "mat", "Ωμ", "x", "~z"]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(0, 30)))
    return [(rng.choice(["en", "de", None, "und"]), make()) for _ in range(400)] + [("en", None), (None, None), ("fr", ""), ("en", "a a a a a a a a a")] * 3


@pytest.mark.parametrize(("least", "top", "share"), [(3, 2000, 100), (2, 7, 100), (5, 2000, 60), (10_000, 10, 100)])
def test_collocations_against_counting(spark, monkeypatch, least, top, share):
    monkeypatch.setattr(phrases, "GROUP", 2000)
    rows = phrase_rows()
    df = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, grp int")
    found = phrases.collocations(df, least=least, top=top, share=share).collect()
    assert {tuple(r) for r in found} == brute_collocations(rows, least, top=top, share=share) and len(found) == len({tuple(r) for r in found})


def test_collocations_of_odd_and_no_rows(spark, odd):
    rows = [(r[2], r[1]) for r in odd_rows()]
    assert {tuple(r) for r in phrases.collocations(odd, least=2, top=50).collect()} == brute_collocations(rows, 2, top=50)
    assert phrases.collocations(odd.filter("1 = 0"), least=2).count() == 0


def test_words_of_a_text_longer_than_a_slice():
    text = "Alpha beta, " * 400_000 + "y" * 3_000_000 + " end"
    words = phrases.Words()
    ids = phrases.numbered(phrases.plain([text, "beta"]), words)
    names = list(words)
    assert Counter(names[i] for i in ids.tolist()) == {b"alpha": 400_000, b"beta": 400_001, b"\n": 400_002, b"y" * 3_000_000: 1, b"end": 1}


def test_exact_scores_past_64_bits(spark):
    """The score of counts whose products pass 64 bits, as the query computes it."""
    a, n, left, right = 3 * 10**12, 9 * 10**13, 7 * 10**12, 5 * 10**12
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(phrases.score("a", "n", "l", "r").alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


def test_collocation_query(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op13_collocations(spark, SF).collect()} == brute_collocations(rows, 100)


# --- long texts, and the contract's columns of the scans, from the patterns alone ------------------------------------------


def test_licences_in_a_text_of_several_megabytes():
    """Work grows with the excerpts: 10^5 of them take about five times what 2 * 10^4 take."""
    scanner, rng, took = licenses.LicenceScanner(), random.Random(1), []
    words = [licenses.words_of(t) for _, t in licenses.TEMPLATES]
    for n in (20_000, 100_000):
        out = []
        for _ in range(n):
            t = rng.choice(words)
            i = rng.randrange(max(1, len(t) - 14))
            out += t[i : i + 14] + ["zzz"] * rng.randrange(3)
        began = time.process_time()
        assert len(scanner.scan(" ".join(out))["spans"]) > n / 4
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 2 and took[1] < 60


def test_secrets_in_a_text_of_several_megabytes(spark):
    """Random keys in long runs that do not count as a whole: each is found, in time that grows with their number."""
    rng, took = random.Random(2), []
    model = secrets.train(secrets.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))
    for n in (10_000, 100_000):
        keys = ["".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=24)) for _ in range(n)]
        text = " ".join(keys)
        began = time.time()
        (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
        took.append(time.time() - began)
        assert sum(not s.base for s in row.spans) > 0.95 * n
    assert took[1] < 15 * took[0] + 5 and took[1] < 120


def spans_digest(found):
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))


def luhn(digits):
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_secrets(text):
    assign = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    access = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return assign, access, [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def base_pii(text):
    email = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    card = [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return email, ip, card, [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_scan_queries_give_the_contracts_columns(spark):
    """op7, op8 and op9: counts, digests and places of the base, by Python's patterns."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_secrets(spark, SF).collect():
        kinds = base_secrets(texts[r.doc_id])
        order = {"assign": 0, "access": 1, "hex": 2}
        found = sorted((x for k in kinds for x in k), key=lambda x: (x[1], order[x[0]]))
        assert [r.n_assign, r.n_access, r.n_hex] == [len(k) for k in kinds] and r.base_sha256 == spans_digest(found)
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(","))
    for r in queries.op9_pii(spark, SF).collect():
        kinds = base_pii(texts[r.doc_id])
        found = [x for k in kinds for x in k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(k) for k in kinds] and r.base_sha256 == spans_digest(found)
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(","))
    phrases_ = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in queries.op8_licenses(spark, SF).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        places = sorted((i, label) for p, label in phrases_.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        want = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_other_queries_give_a_row_or_more_for_every_document(spark):
    """op1, op3 to op6 and op10 run over the whole table; their values are held against brute force by their operators' tests."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, held = {r.doc_id for r in docs.collect()}, {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.collect()}
    for query in (queries.op1_packing, queries.op4_ngram_join, queries.op5_byte_bpe, queries.op6_media, queries.op10_exact_dedup):
        assert {r.doc_id for r in query(spark, SF).select("doc_id").collect()} == ids
    assert {r.doc_id: r.held_out for r in queries.op3_language(spark, SF).collect()} == held
    pieces = queries.op1_packing(spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for cuts in by_doc.values():
        cuts.sort()
        assert [c[0] for c in cuts] == [sum(x[1] for x in cuts[:i]) for i in range(len(cuts))] and sum(c[1] for c in cuts) == cuts[0][2]
    for cuts in by_sequence.values():
        cuts.sort()
        assert [c[0] for c in cuts] == [sum(x[1] for x in cuts[:i]) for i in range(len(cuts))] and sum(c[1] for c in cuts) <= 2048
