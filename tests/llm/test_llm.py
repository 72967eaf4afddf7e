"""The training-data operators against brute force on small tables with nulls, ties, copies and odd columns."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockfit.llm import extraction, langid, lines, minhash, mixing, neighbours, packing, quality, suffix, toxicity
from blockfit.llm.common import crc_mod, running_sums
from blockfit.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 60)
    for k in range(8):
        out.append(prose(rng, 30) + " " + passage + "\n" + prose(rng, 25))
    base = prose(rng, 150).split()
    for k in range(8):
        copy = list(base)
        copy[rng.randrange(150)] = "edit%d" % k
        out.append(" ".join(copy).upper() if k % 2 else "\t".join(copy))
    out += [out[0], out[0], None, "", "  \n ", "one two", "One\nTWO", "x" * 450, "ab " * 700, "é" * 130 + passage]
    out.append(" ".join(base + base[:100]) * 3)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else "de", "src%d" % min(k % 7, 2) if k % 11 else None, 7, "x") for k, t in enumerate(texts)]
    rows.append((5, texts[5], "en", "src0", 7, "x"))  # a repeated row
    schema = "doc_id long, text string, lang string, source string, size int, component_id string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return WORD.findall(text or "")


# --- near-duplicates ---------------------------------------------------------------------------


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_match_all_pairs(docs, texts):
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = components(linked, sets)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want[r.doc_id]
        assert r.kept == (r.doc_id == want[r.doc_id])


def test_near_duplicates_chain_needs_more_than_the_smallest(spark):
    """A chain whose ends are unlike the smallest of the bucket is still one component."""
    rng = random.Random(8)
    base, rows = prose(rng, 400).split(), []
    for k in range(12):
        rows.append((k, " ".join(base)))
        for _ in range(3):
            base[rng.randrange(400)] = "w%d" % rng.randrange(10**6)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: shingles(t) for k, t in rows}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    want = components([(a, b) for a in sets for b in sets if a < b and like(a, b)], sets)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()} == want


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    bits = [minhash.packed_bits(minhash.minima(x)).view(np.int64).tolist() for x in (a, b, rng.integers(0, 1 << 63, 900, dtype=np.uint64))]
    frame = spark.createDataFrame([(bits[0], bits[1], bits[2])], "x array<long>, y array<long>, z array<long>")
    near, far, same = frame.select(minhash.estimate("x", "y"), minhash.estimate("x", "z"), minhash.estimate("x", "x")).first()
    assert abs(near - 0.5) < 0.15 and abs(far) < 0.12 and same == 1.0


def test_near_duplicates_empty_and_null_id(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    frame = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert got == {None: (None, True), 3: (3, True), 4: (3, False)}


def test_components_of_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(130, 131), (131, 129)]
    random.Random(1).shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 132)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated strings ---------------------------------------------------------------------------


def removed_bytes(texts, length=100):
    seen, out = {}, {}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            s = data[at : at + length]
            if s in seen:
                gone[at : at + length] = True
            else:
                seen[s] = (k, at)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [64, 0])
def test_repeated_strings_match_all_windows(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_HERE", hot)  # 0: every gram is hot, as closures carry module values by name
    want = removed_bytes(texts)
    got = suffix.remove_repeats(docs, carry=("source",)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        data = (texts[r.doc_id] or "").encode()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert len(r.kept) == len(data) - r.n_removed


@pytest.mark.parametrize("length", [32, 159, 250, 1024])
def test_repeated_strings_of_any_length(spark, length):
    rng = random.Random(length)
    passage = prose(rng, 320)
    texts = [prose(rng, 20) + passage[: 300 * (k % 5) + 10 * k] + prose(rng, 30) for k in range(30)]
    texts += [passage, passage * 2, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix.remove_repeats(frame, length=length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_bytes(texts, length)


def test_repeated_strings_with_hot_grams_match_all_windows(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix, "_block_rows", lambda length: 2)  # called on the driver for the heat
    got = suffix.remove_repeats(docs).collect()
    want = removed_bytes(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("length", [0, 31, 1025])
def test_lengths_without_a_sample_or_too_long_are_errors(docs, length):
    with pytest.raises(ValueError, match="length"):
        suffix.remove_repeats(docs, length=length)


def segment_rows(rng, n, hot, marked=False):
    """Sorted records of grams with few and, if ``hot``, one with ``n`` different segments, all given twice."""
    rows = []
    for gram in range(40):
        for name in range(n if hot and gram == 7 else rng.randint(1, 4)):
            for rank in rng.sample(range(1000), 2):
                rows.append((gram, name + 1, rank, int(suffix._place(rank + name, 5, 9, suffix.SEGMENT))))
    if marked:
        rows += [(9, 0, 0, suffix.MARKER), (9, 0, 0, suffix.MARKER)]
    return np.array(sorted(rows), np.int64).T


def ranked(rows, size, most=64):
    parts = [rows[:, k : k + size] for k in range(0, rows.shape[1], size)]
    out = []
    for batch in suffix._rank_segments(most)(suffix._record(*p) for p in parts):
        out += zip(*[batch.column(c).to_pylist() for c in range(4)])
    repeats = set()
    for gram, end, rank, place in out:
        if place & 7 == suffix.REPEAT:
            repeats |= {(rank, at) for at in range(place >> suffix._START, end)}
    return repeats, sorted(r for r in out if r[3] & 7 != suffix.REPEAT)


@pytest.mark.parametrize("marked", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_segments_of_a_gram_may_come_in_any_batches(hot, marked, monkeypatch):
    rows = segment_rows(random.Random(3), 500, hot, marked)
    want = ranked(rows, rows.shape[1])
    kinds = {r[0]: {q[3] & 7 for q in want[1] if q[0] == r[0]} for r in want[1]}
    assert (kinds.get(7) == {suffix.SINGLE}) == hot and (kinds.get(9) == {suffix.SINGLE}) == marked
    assert sum(r[0] == 7 for r in want[1]) == 500 or not hot
    for limit, size in ((1, 1), (3, 2), (64, 10), (100, 7)):
        monkeypatch.setattr(suffix, "ROWS", limit)
        assert ranked(rows, size) == want


def test_buckets_stay_small_when_documents_grow(monkeypatch):
    monkeypatch.setattr(suffix, "ROWS", 128)
    for n in (100, 400, 1600):
        found = ranked(segment_rows(random.Random(n), n, True), 50)[1]
        buckets = collections.Counter(r[0] for r in found if r[3] & 7 == suffix.BUCKET)
        assert max(buckets.values()) <= 4 and sum(r[0] == 7 for r in found) == n


def test_repeated_strings_over_long_text_and_empty(spark, empty):
    rng = random.Random(2)
    long = prose(rng, 260_000)  # longer than one buffer
    frame = spark.createDataFrame([(1, long), (2, long[600_000:600_400])], "doc_id int, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.remove_repeats(frame).collect()}
    assert got[2] == (400, 400) and got[1] == (len(long), 0)
    assert suffix.remove_repeats(empty).count() == 0


def test_remaining_text_has_no_broken_characters(spark):
    body = "é" * 80  # repeats itself: its strings start earlier in the same document
    other = "".join(chr(0x100 + k) for k in range(80))
    texts = [(1, "a" + body), (2, body + "b"), (3, other + "é"), (4, other + "èb")]  # é and è share a byte
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = suffix.remove_repeats(frame, with_text=True).collect()
    assert {r.doc_id: r.text for r in found} == {1: "aé", 2: "b", 3: other + "é", 4: "b"}
    want = removed_bytes([t for _, t in texts])
    assert {r.doc_id - 1: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want


def test_line_dedup_keeps_first_with_offsets(spark, empty):
    line = "This is a line of more than ten words that repeats a lot"
    rows = [(2, f"x\n{line}\ny"), (1, f"{line}\nshort one"), (3, f" {line.upper()}  \n{line}\nshort one"), (4, None), (1, f"{line}\nshort one")]
    got = collections.defaultdict(list)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in lines.remove_repeated_units(table, min_words=10).collect():
        got[r.doc_id].append((r.n_units, r.n_removed, r.kept, [(s.start, s.length) for s in r.spans]))
    assert got[1] == [(2, 0, f"{line}\nshort one", [])] * 2
    assert got[2] == [(3, 1, "x\ny", [(2, len(line))])]
    assert got[3] == [(3, 2, "short one", [(0, len(line) + 3), (len(line) + 4, len(line))])]
    assert got[4] == [(1, 0, "", [])]
    assert lines.remove_repeated_units(empty).count() == 0
    every = {r.doc_id: r.kept for r in lines.remove_repeated_units(table).collect()}
    assert every == {1: f"{line}\nshort one", 2: "x\ny", 3: "", 4: ""}


def test_short_units_and_paragraphs_are_units(spark):
    rows = [(1, "世界和平\n\nA\nB"), (2, "世界和平\n\na \t\nb"), (3, "A\n\n\nB\n世界和平" + "\nlong" * 20000)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, place int, digest string")
    by_line = {r.doc_id: r.kept for r in lines.remove_repeated_units(table).collect()}
    assert by_line == {1: rows[0][1], 2: "", 3: "\n\nlong"}
    by_paragraph = {r.doc_id: (r.kept, r.n_removed) for r in lines.remove_repeated_units(table, "\n\n").collect()}
    assert by_paragraph[2] == ("a \t\nb", 1) or by_paragraph[2] == ("", 2)
    assert by_paragraph[1] == (rows[0][1], 0)


# --- mixing and packing ----------------------------------------------------------------------------


def test_mix_meets_targets(docs, texts):
    got = mixing.mix_sources(docs).collect()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert r.size == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sum(x.size for x in got if x.source == r.source)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    level = max(
        (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        for k in range(len(order))
        for full in [sorted(order, key=lambda s: 2 * size[s] / weight[s])[:k]]
    )
    for s in order:
        assert math.isclose(target[s], min(2 * size[s], level * weight[s]))
        assert abs(taken[s] - target[s]) <= 0.5
    assert sorted(got) == sorted(mixing.mix_sources(docs).collect())


def test_taken_mix_has_the_words(docs, texts):
    plan = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        plan[r.doc_id] += r.taken
    rows = mixing.take_mix(docs).collect()
    assert collections.Counter({k: n for k, n in plan.items() if n}) == sum(
        (collections.Counter({r.doc_id: len(words(r.text))}) for r in rows), collections.Counter()
    )
    assert all(words(texts[r.doc_id])[: len(words(r.text))] == words(r.text) for r in rows)


def test_mix_and_pack_of_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_running_sums_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "g%d" % rng.randrange(5), k, rng.randrange(100)) for k in range(3000)]
    got = running_sums(spark.createDataFrame(rows, "g string, k long, v long"), "g", ["k"], "v", "test").collect()
    total = collections.Counter()
    want = {}
    for g, k, v in sorted(rows):
        want[k] = total[g]
        total[g] += v
    assert {r.k: r.sum_before for r in got} == want


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs, max_tokens=256, with_ids=True).collect()
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, ids.tolist()))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    for k, t in enumerate(texts):
        want = model.encode(t or "", add_special_tokens=False).ids + [0]
        have = sorted(pieces[k])[:: 2 if k == 5 else 1]
        assert [x for p in have for x in p[2]] == want
        assert [p[1] for p in have] == [sum(len(q[2]) for q in have[:i]) for i in range(len(have))]
        assert all(len(p[2]) == 256 for p in have[1:])
    tokens = sum(r.length for r in got)
    assert len(bins) <= math.ceil(tokens / 256) + 4  # one unfilled bin for each task at most


def test_packing_is_near_the_bound_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    setting = "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(setting), []
    try:
        for n in (4, 200):
            spark.conf.set(setting, str(n))
            found.append(packing.pack_documents(docs).toPandas())
    finally:
        spark.conf.set(setting, before)
    bound = -(-int(found[0].length.sum()) // 2048)
    assert found[0].sequence_id.nunique() == found[1].sequence_id.nunique() <= 1.01 * bound + 1
    keys = ["doc_id", "piece"]
    a, b = (f.sort_values(keys).reset_index(drop=True) for f in found)
    assert a.equals(b)


def test_packers_follow_the_tokens(monkeypatch, spark):
    full = packing.PACKER_SEQUENCES * 2048
    assert [packing.packer_count(x, 2048) for x in (0, full - 1, 3 * full, full * 10**6)] == [1, 1, 3, 20_000]
    monkeypatch.setattr(packing, "PACKER_SEQUENCES", 2)
    rows = [(k, 0, 1 + k * 7 % 10, k) for k in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    got = packing.pack(pieces, max_tokens=10).collect()
    assert len({r.sequence_id >> 33 for r in got}) > 10
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        ends = [0] + list(np.cumsum([n for _, n in sorted(parts)]))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 10


def test_special_token_text_and_same_ids():
    from tokenizers import Tokenizer

    model, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    for t in ("a<|endoftext|>b", "naïve  déjà\n\n vu 123's", "日本語 text", ""):
        assert encode(t) == model.encode(t, add_special_tokens=False).ids


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 8, 2, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (2, 8), (0, 6)]
    assert bins.place(9) == (3, 0) and bins.place(5) == (4, 0) and bins.place(6) == (5, 0)
    assert bins.open == 2 and bins.place(1) == (5, 6) and bins.place(1) == (5, 7)


# --- quality, language, toxicity ----------------------------------------------------------------------


def test_quality_counts(docs, texts):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for k, t in enumerate(texts):
        w, t = words(t), t or ""
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w),
            sum(map(len, w)),
            len(full) - len(set(full)),
            len(inside),
        ), k
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_fertility_bands_reject_codes_and_keep_prose(spark):
    rng = random.Random(4)
    english = "the people of this town have always been proud of their old bridge and its long history " * 1
    rows = [
        (1, english + prose(rng, 5)),
        (2, " ".join("%032x" % rng.getrandbits(128) for _ in range(30))),
        (3, " ".join("\U0001f9ff\U0001faa8" for _ in range(40))),
        (4, " ".join(["a$#"] * 10 + ["%d" % k for k in range(15)]) + " Ωμέγα"),
    ]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].script == "latin"
    assert got[3].fallback_share == pytest.approx(8 / 9)  # of a word's 9 tokens 8 are bytes, one is the space
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_spans(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit_languages(docs.where(~held))
    got = langid.label_languages(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    right, total = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.95
    by = {r.lang: r.text for r in docs.where("lang in ('de', 'fr') and n_chars > 1500").dropDuplicates(["lang"]).collect()}
    mixed = " ".join(by["de"].split()[:80]) + " " + " ".join(by["fr"].split()[:40])
    odd = spark.createDataFrame([(1, mixed), (2, None), (3, "12 ..."), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.label_languages(odd, model, with_spans=True).collect()}
    assert [(found[k].lang_pred, found[k].score) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert found[1].lang_pred == "de" and {s.lang for s in found[1].spans} == {"de", "fr"} and len(found[1].spans) <= 4
    assert langid.label_languages(empty, model).count() == 0
    nothing = langid.fit_languages(empty)
    assert {r.lang_pred for r in langid.label_languages(odd, nothing).collect()} == {"und"}


def test_viterbi_matches_every_path():
    rng = np.random.default_rng(2)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) * 3 for n in (1, 4, 6, 2, 0)]
    for s, path in zip(scores, langid.best_paths(scores, 2.0)):
        value = lambda p: sum(s[t, x] for t, x in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max((value(p) for p in np.ndindex(*[3] * len(s))), default=0)
        assert len(path) == len(s) and abs(value(path) - best) < 1e-4


def test_three_hundred_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}word " * 20, f"l{k:03d}", "r") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(docs, F.lit(True)).collect()}
    assert got == {k: f"l{k:03d}" for k in range(300)}
    path = langid.best_paths([np.eye(300, dtype=np.float32)[[299, 299, 7]] * 9], 1.0)[0]
    assert path.tolist() == [299, 299, 7]


def test_toxicity_held_out(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 3) == 1
    learned = labels.where(~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = toxicity.fit_toxicity(docs, learned)
    got = toxicity.score_toxicity(docs.where(held), fit).join(labels, "doc_id").toPandas()
    rank, ones = got.score.rank(), got.toxic.sum()
    area = (rank[got.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(got) - ones))
    assert area > 0.9 and got.predicted[got.toxic == 0].mean() < 0.03 and got.predicted[got.toxic == 1].mean() > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "x")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, fit).collect()}
    assert scores[1] == scores[2] == scores[3] and all(0 < s < 1 for s in scores.values())
    assert toxicity.score_toxicity(empty, fit).count() == 0


# --- pages and vectors ---------------------------------------------------------------------------------


def test_main_text_of_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extraction.main_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_site_style_tree_cuts_what_a_host_repeats(spark):
    rng = random.Random(6)
    rows = []
    for k in range(30):
        body = prose(rng, 40)
        rows.append(
            (k, f"http://one.example/{k}", f"<html><body><div class='x1'>Same bar everywhere</div><div class='x2'><p>{body} &amp; more<p>{body}</div>"
             f"<div class='x3'>All rights <b>reserved</b></div></body></html>", body)
        )
    rows += [(100, None, None, ""), (101, "http://two.example/", "plain &lt;text&gt;", ""), (102, "u", "<p>a<script>x</p></script>b</p><form>c</form>d<!-- e", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extraction.main_text(frame).collect()}
    for k, _, _, body in rows[:30]:
        assert got[k] == f"{body} & more {body}"
    assert got[100] == "" and got[101] == "plain <text>" and got[102] == "ab d"
    assert extraction.main_text(frame.where("false")).count() == 0


def test_style_tree_decides_inside_and_beside_an_article(spark):
    rng = random.Random(7)
    bodies = [prose(rng, 30) for _ in range(20)]
    page = (
        "<html><body class='postid-{k}'><div class='w-1/2'>Top of all</div><article id='post-{k}'><p>{body}</p>"
        "<div class='b1'>Buy the book</div><div class='b2'><p>more {body}</p></div></article><div class='x'>beside {body}</div></body></html>"
    )
    rows = [(k, f"http://one.example/{k}", page.format(k=1000 + k, body=b)) for k, b in enumerate(bodies)]
    # copies of a page, however many, do not make it a template
    rows += [(100 + k, f"http://two.example/{k}", page.format(k=1000, body=bodies[0])) for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.main_text(frame).collect()}
    for k, body in enumerate(bodies):
        assert got[k] == f"{body} more {body} beside {body}"
    for k in range(40):
        assert got[100 + k] == f"Top of all {bodies[0]} Buy the book more {bodies[0]} beside {bodies[0]}"


def test_class_names_of_layout_are_no_noise(spark):
    pages = [
        "<body class='has-sidebar'><article>a</article></body>",
        "<article class='post single no-sidebar'>b</article>",
        "<div class='site-header-fixed'><p class='content side-by-side'>c</p></div>",
        "<html class='nav menu'><main id=search>d</main><div class='cookie-banner'>x</div><div class='ad'>y</div>",
        "<div class='sidebar'><main>e</main>x</div>",
    ]
    rows = [(k, f"http://h{k}/", p) for k, p in enumerate(pages)]
    rng = random.Random(8)
    shapes = [[rng.choice(["p", "h2", "ul", "pre"]) for _ in range(6)] for _ in range(12)]
    bodies = [prose(rng, 5) for _ in shapes]
    for k, (shape, body) in enumerate(zip(shapes, bodies)):
        inner = "".join(f"<{t}>{body} {n}</{t}>" for n, t in enumerate(shape))
        # a story that goes by a suspicious name, and a real advert
        rows.append((100 + k, f"http://story/{k}", f"<div class='social'>{inner}</div><div class='ad'>buy {body}</div>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.main_text(frame).collect()}
    assert [got[k] for k in range(5)] == list("abcde")
    for k, body in enumerate(bodies):
        assert got[100 + k] == " ".join(f"{body} {n}" for n in range(6))


def test_declared_parts_win(spark):
    page = (
        "<header>h</header><nav>n</nav><div class='cookie-notice'>c</div><article><h1>T&eacute;st</h1><p>one<br>two&nbsp; three"
        "<aside>a</aside><ul><li>l1<li>l2</ul><pre>x  y</pre><section id=comments><p>z</p></section></article><div class='sidebar'>s</div><footer>f</footer>"
    )
    frame = spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")
    assert extraction.main_text(frame).first().text == "Tést one two three l1 l2 x y"


def test_nearest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(900, 16)).astype(np.float32)
    data[700:760] = data[3]
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(data)]
    rows += [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [float("nan")] * 16, "x"), (1050, [1.0] * 15 + [None], "x"), (1051, [1.0], "x")]
    rows.append(rows[7])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = collections.defaultdict(list)
    queries = frame.where(F.col("vec_id") % 50 == 0).unionByName(frame.where("vec_id = 3"))
    for r in neighbours.nearest(frame, queries, block_rows=200, chunk_rows=7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    d = data.astype(float)
    size, hits = np.sqrt((d * d).sum(axis=1)), 0
    assert set(got) == {3, *range(0, 900, 50)}
    for q, found in got.items():
        score = (d * d[q]).sum(axis=1) / (size * size[q])
        score[q] = -9
        best = np.lexsort((np.arange(900), -score))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(s == score[v] for _, v, s in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[3]] == [700, 701, 702, 703, 704]


def test_nearest_with_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, -1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 0), (50, 2, 7)]
    assert neighbours.nearest(frame.where("false"), frame.where("false")).count() == 0


def test_index_returns_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    codes[:40] = codes[0]
    codes[:40, 3] ^= rng.integers(0, 256, 40, dtype=np.uint8)
    for radius in (0, 3, 9, 20, 40):
        index = neighbours.SubstringIndex(codes, radius)
        for q in codes[:5]:
            apart = np.bitwise_count(codes ^ q).sum(axis=1)
            assert index.within(q).tolist() == np.flatnonzero(apart <= radius).tolist()


# --- the pipeline ----------------------------------------------------------------------------------------


def test_pipeline_drops_near_copies_from_similarity_80(spark):
    import corpus_pipeline as P

    rng = random.Random(12)
    rows, want = [], set()
    for k in range(0, 60, 3):
        text = prose(rng, 200).split()
        # of 196 shingles: 0.83 and 0.77 of the union are in common
        near, far = (text + prose(rng, n).split() for n in (40, 60))
        rows += [(k, " ".join(text)), (k + 1, " ".join(near)), (k + 2, " ".join(far))]
        shared = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert 0.8 <= shared(rows[-3][1], rows[-2][1]) < 0.85 and shared(rows[-3][1], rows[-1][1]) < 0.8
        want |= {k, k + 2}
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars"
    )
    assert {r.doc_id for r in P.drop_near_duplicates(spark, frame, SF).collect()} == want


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    from blockfit.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        result = stored(stage(spark, docs, SF), "test")
        if name != "packing":
            assert result.columns == docs.columns
            assert {r.doc_id for r in result.collect()} <= set(before)
        docs_before, docs = docs, result
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    tokens = docs_before.count()
    assert docs.where("piece = 0").count() == tokens
