"""Exact copies, token alignment and fill-in-the-middle against brute force, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockfit.llm import alignment, copies, infill
from blockfit.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    letters = "abcdefghij"
    out = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out += [
        None, "", " ", "\n", "  two  spaces\t\tand\ttabs ", " two spaces and tabs ", "línea única — ñandú",
        "世界 😀 emoji 👩‍👩‍👧 क्षत्रिय", "Ωμέγα hard space x", "a <P> mark", "<<P", "x<S", "it's 'll I've 2024-01-02 !!! ...",
        "▁ a low line", "control \x00\x01\x1f x", "<|endoftext|> kept <|endoftext|>", "cr\r\nlf \n \n b", "ﬁ ligature é",
        "<s> </s> <unk> <0x41>", "word " * 3000, "é" * 5000, "no end" + "x" * 20000,
    ]
    return out + out[:12] + out[:3] * 30


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(len(texts) - k, t, "r", 1, "g", "d") for k, t in enumerate(texts)]
    rows += [rows[0], rows[41], (None, texts[1], "r", 1, "g", "d"), (None, "only without id", "r", 1, "g", "d")]
    schema = "doc_id long, text string, row string, key int, groups string, digest string"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("tracked", [4, 4096])
def test_one_row_of_equal_texts_stays(docs, rows, tracked):
    got = copies.exact_copies(docs, tracked=tracked, buckets=2).collect()
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[sha(SPACE.sub(" ", text or ""))].append(doc_id)
    assert len(got) == len(rows)
    kept = collections.Counter()
    for r in got:
        ids = groups[r.text_sha256]
        smallest = min((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids) and r.keep_id == smallest
        assert not r.kept or r.doc_id == smallest
        kept[r.text_sha256] += r.kept
    assert sorted((r.doc_id, r.text_sha256) for r in got if r.doc_id) == sorted(
        (i, h) for h, ids in groups.items() for i in ids if i
    )
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_frequent_digests_are_found_in_two_levels(spark):
    ids = spark.range(0, 40_000, 1, 16)
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 0, F.lit(1)).otherwise(F.col("id") + 5)
    table = ids.select(F.unhex(F.sha2(hot.cast("string"), 256)).alias("digest"))
    found = copies.frequent_digests(table, tracked=64, buckets=3)
    keys = {r.key for r in found.collect()}
    want = spark.createDataFrame([("0",), ("1",)], "v string")
    hashes = want.select(F.xxhash64(F.unhex(F.sha2("v", 256))).alias("k")).collect()
    assert {r.k for r in hashes} <= keys and len(keys) <= 64


def test_copies_run_without_python(spark, docs):
    plan = copies.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan


def test_copies_of_nothing(docs):
    assert copies.exact_copies(docs.where("false")).collect() == []


def whole_alignment(text):
    """Groups and links by whole-text encodings and decoded bytes alone."""
    tool = alignment.aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    if not text:
        return 0, 0, [], []
    a = tool.a.encode(" " + text, add_special_tokens=False).ids
    b = tool.b.encode(text)
    bytes_a, bytes_b = [tool.bytes_a[i] for i in a], [tool.bytes_b[i] for i in b]
    if not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
        return 0, 0, [], []
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), groups, links


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_alignment_is_that_of_whole_texts(spark, docs, rows, limit, monkeypatch):
    monkeypatch.setattr(alignment, "_LOT", 3)
    got = alignment.align_tokenizers(docs, with_groups=True, max_broadcast=limit).collect()
    found = [(doc_id, *whole_alignment(text)) for doc_id, text in rows]
    count = collections.Counter(link for *_, links in found for link in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = [
        (
            doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
            sum(count[x] for x in links), sha(";".join(groups)) if groups else "", ";".join(groups),
        )
        for doc_id, n_a, n_b, groups, links in found
    ]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert sum(r.n_a == 0 for r in got) < 12 and any(r.n_links > 1000 for r in got)


def test_alignment_of_test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in alignment.align_tokenizers(table).collect()}
    for r in table.collect():
        n_a, n_b, groups, links = whole_alignment(r.text)
        mine = got[r.doc_id]
        assert (mine.n_a, mine.n_b, mine.n_groups, mine.n_links) == (n_a, n_b, len(groups), len(links))
        assert mine.groups_sha256 == (sha(";".join(groups)) if groups else "")


def test_tokenizers_without_safe_cuts_get_whole_texts(docs, monkeypatch):
    path_a, path_b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    tool = alignment.Aligner(path_a, path_b)
    assert tool.parts("a b  c") == ["a", "b  c"]
    tool.by_part = False
    assert tool.parts("a b  c") == ["a b  c"]
    table = alignment.PartTable(tool)
    table.learn({"a b  c"})
    assert table.groups[0] == ";".join(whole_alignment("a b  c")[2])


def test_spans_refined_by_decoded_bytes():
    # three characters of 1, 3 and 1 bytes; the second is spelled by two tokens that share its span
    place = np.array([0, 1, 4, 5])
    spans = np.array([[0, 1], [1, 2], [1, 2], [2, 3]])
    ends = alignment.byte_ends(place, spans, np.array([1, 1, 2, 1]), np.zeros(4, bool))
    assert ends.tolist() == [1, 2, 4, 5]
    # the same by single bytes, of which all but the last have an empty span
    spans = np.array([[0, 1], [1, 1], [1, 1], [1, 2], [2, 3]])
    spelled = np.array([False, True, True, True, False])
    assert alignment.byte_ends(place, spans, np.ones(5, int), spelled).tolist() == [1, 2, 3, 4, 5]


def test_known_parts_are_forgotten(docs, monkeypatch):
    want = sorted(r.groups_sha256 for r in alignment.align_tokenizers(docs).collect())
    monkeypatch.setattr(alignment, "_KEPT_BYTES", 1)
    assert sorted(r.groups_sha256 for r in alignment.align_tokenizers(docs).collect()) == want


def test_alignment_of_nothing(docs):
    assert alignment.align_tokenizers(docs.where("false")).collect() == []


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text), text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text), out


def test_infill_matches_plain_slices(docs, rows):
    got = infill.fill_in_middle(docs, with_output=True).collect()
    order = lambda r: tuple(str(x) for x in r)
    want = [(doc_id, *plain_infill(doc_id, text)) for doc_id, text in rows]
    assert sorted((tuple(r)[:8] for r in got), key=order) == sorted(want, key=order)
    forms = collections.Counter(r.form for r in got)
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 3
    text_of = collections.defaultdict(set)
    for doc_id, text in rows:
        text_of[doc_id].add(text or "")
    for r in got:
        # the descriptors over the text and the joined marks give the output
        found = {
            b"".join((t.encode(), b"<P><S><M>")[p.buffer][p.start : p.start + p.length] for p in r.pieces)
            for t in text_of[r.doc_id]
        }
        assert r.output.encode() in found and len(r.pieces) == (1 if r.form == "plain" else 6)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_of_a_table_comes_back(form, monkeypatch):
    marks = [m.encode() for m in infill.SENTINELS]
    text = "<ab<P é世<".encode()
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            table = infill.PieceTable((text, b"".join(marks)), [(infill.TEXT, 0, len(text))])
            table.cut(a)
            table.cut(b)
            table.pieces += infill.mark_pieces(marks)
            output = table.arranged(infill.ORDERS[form]).content()
            assert len(output) == len(text) + 9
            assert infill.opened(output, form, marks).content() == text
    with pytest.raises(ValueError):
        table.cut(10_000)


def test_units_across_texts_and_blocks(monkeypatch):
    monkeypatch.setattr(infill, "_BLOCK", 4)
    data = np.frombuffer("abcde-fghé".encode() + b"xy", np.uint8)
    starts, lead = infill.unit_starts(data, np.array([0, 11]))
    assert np.flatnonzero(starts).tolist() == [0, 5, 6, 9, 11] and lead.sum() == 12
    assert [infill.place_of(starts[:11], k) for k in range(5)] == [0, 5, 6, 9, 11]


def test_infill_of_nothing_and_bad_marks(docs):
    assert infill.fill_in_middle(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, sentinels=("<P>", "[S]", "<M>"))
