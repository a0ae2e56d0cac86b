"""Every operator on the table of odd cases, against brute force."""

import hashlib
import textwrap
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meteospan.llm import bpe, decontaminate, license_scan, line_dedup, ngram_join, pii, quality_rules, substring_dedup, token_files, warc
from meteospan.llm.store import new_folder

public_tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_quality_rules(docs, empty, rows):
    found = quality_rules.quality_rules(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(found, *names) == Counter((i, *brute.quality(t)) for i, t in rows)
    assert found.filter("base_failed AND kept").count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == found.filter("kept").count() > 5
    assert quality_rules.quality_rules(empty).count() == 0 == quality_rules.keep_good(empty).count()


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(docs, empty, rows, size, percent):
    found = ngram_join.ngram_components(docs, size, percent)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == Counter(brute.components(rows, size, percent))
    if size == 4:
        assert ngram_join.ngram_components(empty, size, percent).count() == 0


def test_ngram_join_in_blocks(docs, rows, monkeypatch):
    """Lists cut into many blocks, so that the second round has to join them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 150)
    found = ngram_join.ngram_components(docs, 4, 60)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == Counter(brute.components(rows, 4, 60))


def test_divide_skip():
    rng = np.random.default_rng(1)
    for _ in range(300):
        lists = [np.sort(rng.choice(30, rng.integers(1, 15), replace=False)) for _ in range(rng.integers(1, 12))]
        least = int(rng.integers(1, 8))
        count = Counter(int(x) for one in lists for x in one)
        for mu in (0.01, 0.5):
            ids, times = ngram_join.divide_skip(np.concatenate(lists), np.array([len(x) for x in lists]), least, mu, block=3)
            assert dict(zip(ids.tolist(), times.tolist())) == {k: v for k, v in count.items() if v >= least}


def test_search_links_find_the_components():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(1, 20)):
            x = base[: rng.integers(20, 61)].copy()
            x[rng.choice(len(x), rng.integers(0, 8), replace=False)] = rng.integers(0, 1 << 62)
            sets.append(np.unique(x))
        want = ngram_pairs(sets, 85)
        got = {tuple(sorted(p)) for p in ngram_join.search_links(sets, [None] * len(sets), 85)}
        assert got <= want and parts(got, len(sets)) == parts(want, len(sets))


def ngram_pairs(sets, percent):
    both = lambda a, b: len(np.intersect1d(a, b))
    return {
        (i, j) for j in range(len(sets)) for i in range(j)
        if 100 * (c := both(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - c)
    }


def parts(pairs, n):
    group = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


def test_line_dedup(docs, empty, rows):
    found = line_dedup.dedup_lines(docs, bits=16)
    assert rows_of(found, "doc_id", "text", "n_lines", "n_dropped") == Counter(brute.dedup_lines(rows))
    assert sum(r[3] for r in brute.dedup_lines(rows)) > 5
    assert set(docs.columns) - {"n_lines"} <= set(found.columns)
    assert line_dedup.dedup_lines(empty, bits=16).count() == 0


def test_line_dedup_with_full_filters(docs, rows):
    """Filters of a few bits suspect nearly every line; the result stays the same."""
    found = line_dedup.dedup_lines(docs, least=5, repeats=2, bits=4)
    assert rows_of(found, "doc_id", "text", "n_lines", "n_dropped") == Counter(brute.dedup_lines(rows, 5, 2))


@pytest.mark.parametrize("at_once", [1 << 20, 100])
def test_decontaminate(docs, empty, rows, benchmark, at_once):
    items, table = benchmark
    found = decontaminate.contamination(docs, table, at_once=at_once)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect())
    want = brute.contamination(rows, items)
    assert got == Counter((i, n, h, tuple(x), c) for i, n, h, x, c in want)
    assert any(c for *_, c in want)
    texts = Counter(rows)
    for r in found.filter("n_hit > 0").collect():  # the spans of the original text hold the hit words
        text = next(t for (i, t) in texts if i == r.doc_id and t and len(brute.ITEM_WORD.findall(t.translate(brute.LOWER))) == r.n_words)
        assert sum(len(brute.ITEM_WORD.findall(text[s.start : s.end].translate(brute.LOWER))) for s in r.spans) == r.n_hit
    assert decontaminate.contamination(empty, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).filter("n_hit > 0").count() == 0
    clean = decontaminate.keep_clean(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(not c for *_, c in want)


def test_pii_base(docs, empty, rows):
    found = pii.disclosing_spans(docs)
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r["spans"] if s.action == "base")) for r in found.collect())
    assert got == Counter((i, tuple(brute.pii_spans(t))) for i, t in rows)
    assert pii.disclosing_spans(empty).count() == 0


def test_pii_terms(spark):
    texts = ["Ask Quentin at q.t@mail.org for it"] * 4 + ["Ask Robin at r.b@mail.org for it", "Ask the river for it", None] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.disclosing_spans(df, around=40).withColumn("text", pii.F.lit(None))
    for r in found.collect():
        text = texts[r.doc_id] or ""
        terms = {text[s.start : s.end] for s in r["spans"] if s.kind == 4}
        assert terms == ({"Quentin"} if "Quentin" in text else {"Robin"} if "Robin" in text else set())
    out = df.join(pii.disclosing_spans(df, around=40).withColumnRenamed("spans", "s"), "doc_id").select("doc_id", pii.sanitised(df.text, pii.F.col("s")).alias("t"))
    assert {r.t for r in out.collect()} == {"Ask  at [email] for it", "Ask the river for it", ""}


def test_pii_marked_terms_against_re(spark):
    """Offsets of terms from the cut parts, beyond one block of parts and with wide characters."""
    import re

    known = {"abc": "remove", "zürich": "generalise", "straße": "remove", "\U0001d400bc": "remove", "ab": "remove", "a1b": "remove"}
    piece = "Abc, abc-abc\U0001f600abc abc1 ab a1b  ZÜRICH Straße! \U0001d400bc xabc é́abc\n"
    texts = ["", " ", " abc ", " ab ", " " + piece + " ", " " + piece * 70 + " ", " " + "x " * 600 + "abc ", " " + "abc " * 600]
    df = spark.createDataFrame([(i, t, known) for i, t in enumerate(texts)], "i int, t string, m map<string,string>")
    for r in df.select("t", pii.marked(F.col("t"), "m").alias("found")).collect():
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", r.t) if re.fullmatch(r"[^\W\d_]{3,24}", m.group())]
        assert [tuple(f) for f in r.found] == [w for w in words if w[2] in known]


def test_pii_works_out_spans_and_terms_once(spark, tmp_path):
    """One scan of the texts looks for spans and terms; the last plan looks for places of known terms only."""
    text = "Quentin at q.t@mail.org or 10.0.0.1 or 4111 1111 1111 1111"
    spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = pii.op5_pii(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(pattern in plan for pattern in pii.PATTERNS.values())
    assert {r.spans for r in found.collect()} == {"email:11:23,ip:27:35,card:39:58"}


def test_pii_numbers_against_re(spark):
    """Numbers and addresses next to more digits, points, blanks and signs."""
    rng = np.random.default_rng(13)
    texts = ["".join(rng.choice(list("0123456789.- +"), 60, p=[0.05] * 4 + [0.08] * 6 + [0.14, 0.06, 0.1, 0.02])) for _ in range(300)]
    texts += [f"{a}4111 1111 1111 1111{b}" for a in ("", "1", "1 ", "x", "-") for b in ("", "1", " 1", "  1", "-")]
    texts += [f"{a}1.2.3.4{b}" for a in ("", "0", ".", "9.", "x") for b in ("", ".", ".5", "5", "a")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", pii.base_spans(F.col("t")).alias("s")).collect():
        assert [(x.start, x.kind, x.end) for x in r.s] == brute.pii_spans(r.t)


def test_pii_terms_far_from_the_entity(spark):
    far = "and so on " * 20
    texts = [f"Quentin {far} q.t@mail.org, 12 {far} quentin."] * 4 + ["Robin and Quentin"] + [f"nobody {far}"] * 11
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.disclosing_spans(df).collect():
        terms = [texts[r.doc_id][s.start : s.end] for s in r["spans"] if s.kind == 4]
        assert terms == (["Quentin", "quentin"] if r.doc_id < 4 else ["Quentin"] if r.doc_id == 4 else [])


def test_license_scan(spark, docs, empty):
    mit = license_scan.KNOWN[0][1]
    texts = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (2, "Some prose.\n* Released  under the MIT Licence!\nmore"), (3, None), (4, ""),
        (5, "(c) 2001 nobody"), (6, mit + " and more"), (2, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, digest string")
    got = Counter((r.doc_id, r.license_id, tuple(r.line_licenses)) for r in license_scan.license_scan(df).collect())
    assert got == Counter([(1, "MIT", ("MIT",)), (2, None, ("MIT",)), (3, None, ()), (4, None, ()), (5, None, ()), (6, None, ()), (2, "CC-BY-NC-4.0", ("CC-BY-NC-4.0",))])
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(empty).count() == 0
    own = spark.createDataFrame([("own", "some prose released under the mit licence more"), ("none", None)], "license_id string, text string")
    assert license_scan.license_scan(df, own).filter("license_id = 'own'").count() == 1


def test_licenses_as_published(spark):
    texts: dict[str, str] = {}
    for i, t in license_scan.KNOWN:
        texts.setdefault(i, t)
    mit, isc = (next(t for i, t in license_scan.KNOWN if i == name) for name in ("MIT", "ISC"))
    year = "Copyright (c) 2020, A. Person <a@example.org>"
    at = "copyright notice and this permission notice appear in all copies."
    wrapped_isc = isc.replace(" " + at, "\n" + at)
    assert ("\n" + at) in wrapped_isc
    wrap = lambda t, width=70, lead="": "\n".join(lead + x for x in textwrap.wrap(t, width))
    rows = [
        (1, "ISC", "ISC License\n\n" + year + "\n\n" + wrapped_isc),
        (2, "MIT", "The MIT License (MIT)\n\nCopyright © 2019 B\nCopyright 2020 C. All rights reserved.\n\n" + wrap(mit)),
        (3, "MIT", "Copyright (c) 2020 X. " + mit),
        (4, "BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\nAll rights reserved.\n\n" + wrap(texts["BSD-3-Clause"], 79)),
        (5, "MIT", "Copyright The Project Authors. All rights reserved.\n" + wrap(mit, 60, "// ")),
        (6, "Apache-2.0", "# (C) 2021 D\n" + wrap(next(t for i, t in license_scan.KNOWN if i == "Apache-2.0"), 75, "# ")),
        (7, None, "(c) You must retain, in the source form, all notices\n" + wrap(mit)),
        (8, None, "Copyright law is old.\n" + wrap(mit)),
        *[(10 + n, i, wrap(t, 50 + n, " * ")) for n, (i, t) in enumerate(license_scan.KNOWN)],
    ]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(df).collect()}
    assert got == {i: want for i, want, _ in rows}


def test_bpe(docs, empty, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    both = bpe.bpe_decode(bpe.bpe_encode(docs, path), path)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in both.collect()) == want
    assert bpe.bpe_decode(bpe.bpe_encode(empty, path), path).count() == 0


def test_bpe_round_trip_is_both_in_one_pass(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    one, two = bpe.bpe_round_trip(docs, path), bpe.bpe_decode(bpe.bpe_encode(docs, path), path)
    assert one.schema == two.schema
    found = [Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()) for df in (one, two)]
    assert found[0] == found[1] and found[0]
    assert bpe.bpe_round_trip(empty, path).count() == 0
    shouted = docs.withColumnRenamed("text", "TEXT").selectExpr("doc_id", "TEXT", "1 AS ids")
    one, two = bpe.bpe_round_trip(shouted, path, "TEXT"), bpe.bpe_decode(bpe.bpe_encode(shouted, path, "TEXT"), path, text_col="TEXT")
    assert one.columns == two.columns and one.exceptAll(two).isEmpty()


def test_bpe_classes_of_characters():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocab = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = np.random.default_rng(3)
    points = [int(p) for p in rng.integers(0, 0x110000, 30_000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"{'a1! '[p % 4]}{chr(p)}" for p in points[i : i + 50]) for i in range(0, len(points), 50)]
    got = bpe.encode_texts(pa.array(texts), vocab, bpe.PieceCache(vocab.merge))
    for raw, e in zip(got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids


def test_token_files(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    shards = token_files.write_tokens(docs, path, new_folder(spark, "tokens"), shard_docs=7)
    assert shards.count() > 2
    got = sorted(token_files.read_tokens(shards).collect(), key=lambda r: (r.start, r.n_tokens))
    encoded = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows]
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(encoded)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    some = token_files.read_tokens(shards, [15, 4]).collect()
    assert {(r.doc_id, r.start, bytes(r.ids)) for r in some} == {(r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in (15, 4)}
    assert token_files.read_tokens(token_files.write_tokens(empty, path, new_folder(spark, "tokens"))).count() == 0


def test_token_file_is_plain_zstandard_with_checked_frames(tmp_path):
    import zstandard

    with open(tmp_path / "a.zst", "wb") as out:
        writer = token_files.ShardWriter(out, 2)
        docs = [(i, np.arange(i * 5000 % 90_000, dtype="<u2").tobytes()) for i in range(60)]
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    raw = (tmp_path / "a.zst").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
        assert stream.read() == b"".join(x for _, x in docs)
    with pa.OSFile(str(tmp_path / "a.zst")) as source:
        reader = token_files.ShardReader(source, len(raw))
        assert len(reader.table) > 3
        assert [(i, x.tobytes()) for i, _, x in reader.documents()] == docs
    spoilt = bytearray(raw)
    spoilt[10] ^= 1
    with pa.BufferReader(bytes(spoilt)) as source, pytest.raises(Exception):
        list(token_files.ShardReader(source, len(spoilt)).documents({0, 1, 2, 3, 4, 5}))


def test_warc(spark, rows):
    big = "é" * 100_000
    pages = [
        (3, "http://a/", "x" * 100), (1, "http://b/", "x" * 100), (2, None, "x" * 100), (2, None, "x" * 100), (4, "u\r\nv", "y" * 99), (5, "c", "y" * 99),
        (6, "d", None), (7, "d", ""), (8, "e", big), (9, "f", big), (None, "g", big), (None, "h", "z" * 200), (10, "i", "\r\n\r\n" * 50),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, copy string").repartition(3)
    chunks = warc.read_warc(warc.write_warc(warc.chunk_table(df), new_folder(spark, "warc")))
    first = {}
    for page_id, _, html in pages:
        if len((html or "").encode()) >= 100 and page_id is not None:
            first[html] = min(page_id, first.get(html, page_id))
    want = Counter()
    for page_id, _, html in pages:
        raw = (html or "").encode()
        refers = first.get(html) if first.get(html, page_id) != page_id else None
        want[page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    assert rows_of(chunks.filter("last"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    parts = chunks.filter("page_id = 8").orderBy("chunk_no").collect()
    assert len(parts) == 4 and b"".join(bytes(r.data) for r in parts) == big.encode()
    assert warc.read_warc(warc.write_warc(warc.chunk_table(df.limit(0)), new_folder(spark, "warc"))).count() == 0


def test_passages(docs, empty, rows, spark):
    found = substring_dedup.repeated_passages(docs).collect()
    split = [(i, brute.words((t or "").translate(brute.LOWER))) for i, t in rows]
    runs: dict[tuple, set] = {}
    for i, w in split:
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set().union(*[s for s in runs.values() if len(s) > 1])
    got = {i for r in found for i in (r.doc_id, r.other_id)}
    assert want <= got and not got & {13, 4, 5, 20, 21}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in found:
        assert r.n_matched >= 50 and r.n_matched >= 0.8 * r.n_words
        assert any(brute.words(t[r.start : r.end]) for t in texts[r.doc_id])
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_fuzzy_passage(spark):
    from conftest import prose

    rng = np.random.default_rng(4)
    tokens = [f"w{x}" for x in rng.integers(0, 10_000, 300)]
    copy = list(tokens[100:200])
    copy[25] = "changed"
    del copy[50]
    copy.insert(75, "added")
    a, b = " ".join(tokens), prose(50, 80) + " " + " ".join(copy) + " " + prose(51, 80)
    df = spark.createDataFrame([(1, a), (2, b), (3, prose(52, 200))], "doc_id long, text string")
    (row,) = substring_dedup.repeated_passages(df).collect()
    assert (row.doc_id, row.other_id) == (2, 1) and row.n_matched >= 96
    assert b[row.start : row.end] == " ".join(copy) and a[row.other_start : row.other_end] == " ".join(tokens[100:200])


def _unjoined(found, texts):
    """Windows of 50 words whose documents do not hang together by passages that hold the window."""
    words = {i: brute.words(t) for i, t in texts.items()}
    where, out = {}, set()
    for i, w in words.items():
        ends = np.cumsum([len(x) + 1 for x in w]).tolist()
        begins = [0, *ends]
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), []).append((i, begins[k], ends[k + 49] - 1))
    for window, places in where.items():
        ids = {i for i, *_ in places}
        if len(ids) < 2:
            continue
        near = {i: {i} for i in ids}
        holds = lambda i, a, b: any(j == i and a <= p and q <= b for j, p, q in places)
        for r in found:
            if holds(r.doc_id, r.start, r.end) and holds(r.other_id, r.other_start, r.other_end):
                both = near[r.doc_id] | near[r.other_id]
                near.update(dict.fromkeys(both, both))
        if near[min(ids)] != ids:
            out.add(window)
    return out


@pytest.mark.parametrize("quotes", [[(0, 45), (27, 72), (54, 99)], [(0, 49), (1, 50), (50, 99)]])
def test_passage_whose_seeds_have_other_partners(spark, quotes):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    texts, pairs = {}, []
    for group in range(5):
        passage = fresh(99 if quotes[0][1] == 45 else 50)
        parts = [passage[a:b] for a, b in quotes if a < len(passage)]
        for part in [*parts, passage, *parts, passage]:
            texts[len(texts)] = " ".join(fresh(30) + part + fresh(30))
            if part is passage:
                pairs.append(len(texts) - 1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = substring_dedup.repeated_passages(df).collect()
    assert {(r.other_id, r.doc_id) for r in found} == set(zip(pairs[::2], pairs[1::2]))
    assert not _unjoined(found, texts)


@pytest.mark.parametrize("contexts, parts, told", [(3, 1, 9), (9, 1, 1 << 20), (40, 1, 0), (9, 4, 0), (40, 4, 1 << 20)])
def test_windows_of_documents_hang_together(spark, contexts, parts, told, monkeypatch):
    """Documents that are cut from one long passage at chance, each between words of its own."""
    monkeypatch.setattr(substring_dedup, "CROWDED", told)
    rng = np.random.default_rng(contexts)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    passage, texts = fresh(160), {}
    for i in range(contexts * 2):
        a = int(rng.integers(0, 100))
        texts[i] = " ".join(fresh(20) + passage[a : a + int(rng.integers(45, 61))] + fresh(20))
    texts[len(texts)] = " ".join(passage)
    texts[len(texts)] = " ".join(fresh(5) + passage)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    assert not _unjoined(substring_dedup.repeated_passages(df).collect(), texts)


def test_fuzzy_passage_whose_seeds_have_other_partners(spark):
    """No 50 words in a row are equal, and the documents before have parts of the passage only."""
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    texts, pairs = {}, []
    for group in range(5):
        passage = fresh(99)
        parts = [passage[a:b] for a, b in ((0, 45), (27, 72), (54, 99))] * 4
        for part in [*parts, passage, *parts, passage]:
            if part is passage:
                pairs.append(len(texts))
                part = [w if i % 33 != 10 + len(pairs) % 2 else f"edit{len(texts)}" for i, w in enumerate(part)]
            texts[len(texts)] = " ".join(fresh(30) + part + fresh(30))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = substring_dedup.repeated_passages(df).collect()
    assert {(r.other_id, r.doc_id) for r in found} == set(zip(pairs[::2], pairs[1::2]))
    assert all(r.n_matched >= 80 for r in found)


@pytest.mark.parametrize("told", [0, 1 << 20])
def test_copied_texts_are_linked_as_wholes(spark, told, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COPIED", told)
    rng = np.random.default_rng(11)
    fresh = lambda n: " ".join(f"vé{x}" for x in rng.integers(0, 1 << 40, n))
    text, short = f" {fresh(70)}\n", fresh(49)
    rows = [(3, text), (1, text), (None, text), (3, text), (7, text + fresh(5)), (2, short), (4, short), (5, None), (6, None), (8, ""), (9, "")]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.n_words, r.n_matched) for r in found} == {(1, None, 70, 70), (3, None, 70, 70), (7, None, 70, 70)}
    assert len(found) == 3 and all((r.start, r.end) == (r.other_start, r.other_end) == (1, len(text) - 1) for r in found if r.doc_id != 7)


def test_links_of_seeds_against_all_pairs():
    """Of seeds that occur in up to PAIRED places all pairs in different documents; of others each place that has an earlier document."""
    rng = np.random.default_rng(12)
    for _ in range(50):
        n = int(rng.integers(0, 400))
        code, doc, pos = (rng.integers(0, high, n) for high in (8, 30, 1000))
        order = np.lexsort((pos, doc, code))
        code, doc, pos = code[order], doc[order], pos[order]
        far, near, *_ = substring_dedup.link(code, doc, pos, code == 3)
        got = list(zip(far.tolist(), near.tolist()))
        assert len(got) == len(set(got)) and (code[far] == code[near]).all() and (doc[far] > doc[near]).all()
        for c in np.unique(code):
            at = np.flatnonzero(code == c).tolist()
            want = {(i, j) for i in at for j in at if doc[i] > doc[j]}
            if len(at) <= substring_dedup.PAIRED and c != 3:
                assert want == {(i, j) for i, j in got if code[i] == c}
            else:
                assert {i for i, _ in want} == {i for i, _ in got if code[i] == c}


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_contamination_without_texts(docs, benchmark, at_once):
    _, table = benchmark
    whole = decontaminate.contamination(docs, table, at_once=at_once)
    narrow = decontaminate.contamination(docs, table, at_once=at_once, keep_text=False)
    assert narrow.columns == [c for c in whole.columns if c != "text"]
    assert Counter(map(str, narrow.collect())) == Counter(map(str, whole.drop("text").collect()))


def test_lists_of_one_hub_share_a_task(spark, monkeypatch):
    """Near copies make many lists; a task that has one of them has most of the others too, so that it needs each text once."""
    rng = np.random.default_rng(15)
    rows = []
    for family in range(30):
        words = [f"v{x}" for x in rng.integers(0, 1 << 40, 150)]
        for _ in range(6):
            copy = list(words)
            copy[int(rng.integers(0, 150))] = f"edit{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    seen, search = [], ngram_join._search
    monkeypatch.setattr(ngram_join, "BLOCK", 1 << 11)
    monkeypatch.setattr(ngram_join, "_search", lambda tasks, *a: seen.append(tasks) or search(tasks, *a))
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85)
    assert {r.component_id == r.doc_id // 6 * 6 for r in found.collect()} == {True}
    assert seen[0].select("task").distinct().count() > 5
    assert 180 <= seen[0].count() < 270  # 492, when each list is dealt out for itself


def test_order_in_groups():
    rng = np.random.default_rng(16)
    for n in (1, 200, 70_000):
        number = rng.integers(0, n, 5000)
        assert (ngram_join._in_groups(number, n) == np.lexsort((np.arange(5000), number))).all()


def test_only_stretches_of_benchmark_words_are_scanned():
    rng = np.random.default_rng(14)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 6, n))) for i, n in enumerate((5, 4, 3, 9, 4))]
    matcher = decontaminate.Matcher(items, 4)
    known = {w.encode() for _, t in items for w in t.split()}
    for _ in range(300):
        words = [f"w{x}".encode() for x in rng.integers(0, 8, int(rng.integers(0, 120)))]
        spans = list(matcher.stretches(words))
        inside = [known.issuperset(words[a:b]) and b - a >= 3 for a, b in spans]
        assert all(inside) and sum(b - a for a, b in spans) <= sum(w in known for w in words)
        hit, found = set(), set()
        for item, text in items:
            for window in decontaminate.windows_of([w.encode() for w in text.split()], 4):
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i : i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        found.add(item)
        ranges, got = matcher.scan(words)
        assert got == found and [i for a, b in ranges for i in range(a, b)] == sorted(hit)


def test_needed_passages_hold_all_windows():
    rng = np.random.default_rng(10)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        word, other, size = (rng.integers(0, 40, n) for _ in range(3))
        exact, size = rng.random(n) < 0.7, size % 20 + 5
        ends = word + size, other + size
        kept = substring_dedup._needed(word, ends[0], other, ends[1], exact, 5)
        for begin, end in ((word, ends[0]), (other, ends[1])):
            held = lambda rows: {x for i in rows for x in range(begin[i], end[i] - 4)}
            assert held(kept) == held(range(n))


def test_repeating_text_is_linked_with_few_passages(spark):
    texts = {1: "la " * 300, 2: "x " + "la " * 200, 3: "la la lo " * 120, 4: "y la la lo " + "la la lo " * 70, 5: "la " * 50}
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert not _unjoined(found, texts) and len(found) < 60
    assert {x for r in found if r.doc_id == 2 for x in range(r.start, r.end)} == set(range(2, 601))


def test_anchors_against_all_windows():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 3 if i % 2 else 1 << 40, n)) for i, n in enumerate([0, 5, 49, 50, 51, 200, 130])]
    (w,) = substring_dedup.ts.words(substring_dedup.pa.array(texts))
    code, doc, at, first, last, context = substring_dedup.anchors(w, 50)
    hashes = w.hashes().tolist()
    seen, of = [], {}
    for c, d, p, a, b, x in zip(code.tolist(), doc.tolist(), at.tolist(), first.tolist(), last.tolist(), context.tolist()):
        for s in range(a, b + 1):
            assert w.first[d] <= s <= p <= s + 42 and s + 50 <= w.first[d + 1]
            assert of.setdefault(tuple(hashes[s : s + 50]), (c, p - s)) == (c, p - s)
            seen.append(s)
        assert of.setdefault((x,), hashes[a : b + 50]) == hashes[a : b + 50]
    assert seen == [s for d in range(7) for s in range(w.first[d], w.first[d + 1] - 49)]


@pytest.mark.parametrize("between", [(40, 40), (40, 47), (0, 60), (90, 30)])
def test_two_passages_with_other_text_between(spark, between):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    first, second = fresh(60), fresh(60)
    a, b = (fresh(30) + first + fresh(n) + second + fresh(30) for n in between)
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    found = substring_dedup.repeated_passages(df).collect()
    texts = {1: " ".join(a), 2: " ".join(b)}
    assert {texts[r.doc_id][r.start : r.end] for r in found} == {" ".join(first), " ".join(second)}
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.other_id][r.other_start : r.other_end] for r in found)


def test_passages_of_a_failing_chain_against_all_stretches():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = rng.integers(0, 1 << 40, 160).astype(np.uint64)
        b = np.where(rng.random(160) < np.repeat(rng.choice([0.0, 0.1, 0.9], 8), 20), np.uint64(1), a)
        same, xs = a == b, [i for i in range(0, 152, 4) if (a[i : i + 8] == b[i : i + 8]).all()]
        if len(xs) < 2 or substring_dedup.align(a, b, xs, xs)[4] >= 0.8 * 160:
            continue
        found = substring_dedup.passages(a, b, xs, xs, 30, 0.8)
        n = lambda i, j: int(same[i:j].sum())
        assert all(a0 == b0 and a1 == b1 and n(a0, a1) == m >= max(30, 0.8 * (a1 - a0)) for a0, a1, b0, b1, m in found)
        inside = range(xs[0], xs[-1] + 8)
        good = {k for i in inside for j in inside[i - inside[0] + 30 :] if n(i, j) >= max(30, 0.8 * (j - i)) for k in range(i, j) if same[k]}
        assert good <= {k for a0, a1, *_ in found for k in range(a0, a1)}


def test_chains_against_all_predecessors():
    rng = np.random.default_rng(5)
    for _ in range(100):
        points = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (rng.integers(2, 25), 2))})
        x, y = (np.array(c, np.int64) for c in zip(*points))
        score = []
        for i in range(len(x)):
            gains = [score[j] - substring_dedup.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            score.append(substring_dedup.SEED_SCORE + max([0.0, *gains]))
        chains = substring_dedup.chains(x, y)
        value = lambda c: substring_dedup.SEED_SCORE * len(c) - substring_dedup.GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert all(x[i] < x[j] and y[i] < y[j] for c in chains for i, j in zip(c, c[1:]))
        assert not chains or value(chains[0]) == pytest.approx(max(score))
        assert chains or max(score) == substring_dedup.SEED_SCORE
