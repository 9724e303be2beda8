"""The training-data operators against brute force, round trips and edge cases."""

import base64
import bisect
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import byte_bpe, licenses, media, merge_automaton, near_dups, packing, pii, quality, substrings, token_counts, warc
from wordloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", None, " \t\n", "one", "é\U0001f600\n中\x1c\x85x", "a" * 20_000, "word " * 8_000, "<|endoftext|> x", "same text here", "same text here"]


def _odd(spark):
    """Null, empty, very long, repeated rows, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "one", "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, spans long")


def _none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in _docs(spark).collect()}


OPERATORS = [near_dups.classes, near_dups.keep, licenses.scan, packing.pack, pii.find, merge_automaton.encode_words, token_counts.attribute, substrings.deduplicate, lambda d: quality.quality_rules(d, None), lambda d: media.resolve(media.sequences(d.withColumnRenamed("text", "html"), "doc_id"), d)]


@pytest.mark.parametrize("run", OPERATORS)
def test_empty_tables(spark, run):
    assert run(_none(spark)).collect() == []


def test_odd_rows(spark):
    """What each operator gives for null, empty, very long and repeated texts, a null id and clashing names, against plain Python."""
    df = _odd(spark)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    each = lambda found, *columns: collections.Counter(tuple(r[c] for c in columns) for r in found.collect())
    want = lambda of: collections.Counter((i, *of(t)) for i, t in rows)
    words = {t: WORD.findall(t) for _, t in rows}

    first, copies = {}, collections.Counter(t for _, t in rows)
    for i, t in rows:
        first[t] = min(first.get(t, i), i, key=lambda x: (x is None, x))
    assert each(near_dups.classes(df), "doc_id", "class_id", "copies", "kept") == collections.Counter((i, first[t], copies[t], i == first[t]) for i, t in rows)
    kept = near_dups.keep(df)
    assert kept.columns == df.columns and collections.Counter((r.doc_id, r.text or "") for r in kept.collect()) == collections.Counter({(i, t): 1 for i, t in rows if i == first[t]})

    plain = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    assert each(licenses.scan(df), "doc_id", "n_words", "n_base", "first_word", "labels", "score") == want(lambda t: (len(plain.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))), 0, None, "", 0.0))

    bytes_, words_ = (Tokenizer.from_file(byte_bpe.vocabulary_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    n_bytes = {t: len(bytes_.encode(t, add_special_tokens=False).ids) for _, t in rows}
    packed = collections.defaultdict(int)
    for r in packing.pack(df).collect():
        packed[r.doc_id, r.doc_tokens] += r.length
    assert packed == {k: k[1] * n for k, n in want(lambda t: (n_bytes[t] + 1,)).items()}
    sections = token_counts.attribute(df).groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n"))
    assert {(r.doc_id, r.doc_tokens): r.n for r in sections.collect()} == {k: k[1] * n for k, n in want(lambda t: (n_bytes[t],)).items()}

    def coded(t):
        ids = words_.encode(t, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes(), words_.decode(ids, skip_special_tokens=False)

    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in merge_automaton.encode_words(df).collect()) == want(coded)
    assert each(pii.find(df).withColumn("n", F.size("spans")), "doc_id", "text", "n") == want(lambda t: (t, 0))
    assert each(substrings.deduplicate(df), "doc_id", "n_words", "n_removed", "kept") == want(lambda t: (len(words[t]), 0, " ".join(words[t])))
    assert each(quality.quality_rules(df, None), "doc_id", "n_words", "word_chars", "kept") == want(lambda t: (len(words[t]), sum(map(len, words[t])), False))
    stored = media.features(media.store(df)).select("digest", "n_bytes").collect()
    assert collections.Counter((r.digest, r.n_bytes) for r in stored) == collections.Counter((hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for _, t in rows)
    assert media.sequences(df.withColumn("html", F.lit(None).cast("string")), "doc_id").filter("size(items) > 0").count() == 0


# near duplicates


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    random.seed(1)
    for _ in range(600):
        a = [random.choice("abcd") for _ in range(random.randrange(50))]
        b = list(a)
        for _ in range(random.randrange(12)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randrange(2)] = random.choice(["", "x", "ab"])
        want = _edit(a, b)
        for limit in (0, 3, 9, 30):
            assert near_dups.distance(a, b, limit) == (want if want <= limit else None)


def test_near_classes(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    passage, rows, want = [word() for _ in range(60)], [], {}
    for group in range(12):
        base = [word() for _ in range(random.choice([80, 200, 900]))]
        for copy in range(random.choice([1, 2, 5])):
            own = list(base)
            for _ in range(len(own) * 2 * (copy > 0) // 100):
                own[random.randrange(len(own))] = word()
            want.setdefault(group, []).append(len(rows))
            rows.append((len(rows), " ".join(own)))
    for _ in range(30):  # unlike documents with one long passage
        rows.append((len(rows), " ".join(passage + [word() for _ in range(30)])))
        want[len(rows)] = [len(rows) - 1]
    rows += [(1000 + i, rows[i][1]) for i in range(5)]
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for members in want.values():
        assert {got[m] for m in members} == {members[0]}
    assert all(got[1000 + i] == got[i] for i in range(5))
    kept = near_dups.keep(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(m[0] for m in want.values())


def test_star_shaped_group(spark):
    """Copies that are near to one original of largest id, but hardly ever to each other."""
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(1000)], []
    for _ in range(60):
        own = list(base)
        for at in random.sample(range(83), 11):
            own[at * 12 : at * 12 + 12] = [word() for _ in range(12)]
        texts.append(own)
    texts.append(base)
    links = [(i, j) for i in range(61) for j in range(i) if near_dups.similarity(texts[i], texts[j], 0.8) is not None]
    assert all((60, j) in links for j in range(60)) and len(links) < 120  # one class, by the original
    got = near_dups.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.class_id for r in got.collect()} == {0}


def test_members_that_match_nobody_are_not_paired_with_all(spark, monkeypatch):
    """A large group around one text, and as many that are a little too far from each of it: classes as by brute force, pairs in proportion."""
    random.seed(5)
    base, texts = [f"w{i}" for i in range(100)], []
    for i in range(81):
        own = list(base)
        for at in random.sample(range(100), 0 if not i else 7 if i % 2 else 24):
            own[at] = f"x{i}y{at}"
        texts.append(own)
    met, verify = [], near_dups.verify

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(near_dups, "verify", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs, k=1).collect()}
    near = [[near_dups.similarity(a, b, 0.8) is not None for b in texts] for a in texts]
    want = list(range(81))
    for _ in range(81):
        want = [min(want[j] for j in range(81) if near[i][j]) for i in range(81)]
    assert got == dict(enumerate(want)) and sum(met) < 81 * 10


def test_bag_filter_leaves_no_match_out():
    random.seed(6)
    for _ in range(60):
        base = [random.choice("abcdefghijkl") for _ in range(random.randrange(1, 60))]
        made = []
        for _ in range(12):
            own = list(base)
            for _ in range(random.randrange(1 + len(base) // 4)):
                at = random.randrange(len(own) + 1)
                own[at : at + random.randrange(2)] = random.choice(["", "x", "ab", "abc"])
            made.append(own or ["z"])
        known = near_dups.Near([" ".join(t).encode() for t in made[1:]], [0] * 11, 0.8)
        at = known.match(" ".join(made[0]).encode(), 0)
        near = [i for i, t in enumerate(made[1:]) if near_dups.similarity(t, made[0], 0.8) is not None]
        assert at in near if near else at is None


def test_classes_are_of_texts(spark):
    """Unlike texts are kept, whatever ids they share with copies; repeated rows and copies without an id go."""
    near = " ".join(f"w{i}" for i in range(60))
    copy, other, third = near.replace("w30 ", "x "), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, near), (7, copy), (7, other), (7, other), (None, copy), (None, third), (None, near), (9, None), (10, "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, own_0 int, kept string")
    kept = near_dups.keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, near), (7, other), (0, third), (9, "")])
    got = collections.Counter((r.doc_id, r.class_id, r.copies, r.kept) for r in near_dups.classes(df).collect())
    assert got == {(1, 1, 2, True): 1, (7, 1, 2, False): 1, (7, 7, 2, True): 2, (None, 1, 2, False): 2, (None, None, 1, True): 1, (9, 9, 2, True): 1, (10, 9, 2, False): 1}


def test_recall_against_all_pairs(spark):
    """Of all pairs of different texts that brute force finds at 0.8 or more, at least 0.95 are in one class, and no class is larger than brute force has it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    words = sorted(((t.split(), i) for t, i in first.items()), key=lambda x: len(x[0]))
    bags, links = [collections.Counter(w) for w, _ in words], []
    for j, (b, y) in enumerate(words):
        for i in range(j - 1, -1, -1):
            a, x = words[i]
            if len(a) < 0.8 * len(b):
                break
            if len(a) >= 5 and (bags[i] & bags[j]).total() >= 0.8 * len(b) and near_dups.similarity(a, b, 0.8) is not None:
                links.append((x, y))
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert len(links) > 50 and sum(got[x] == got[y] for x, y in links) >= 0.95 * len(links)
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in links:
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert all(find(i) == find(got[i]) for _, i in words)


def test_order_counts_beyond_a_hub():
    import pyarrow as pa

    kmers = lambda t: near_dups._kmers(near_dups.kernel.words(pa.array([t])), 1)[0]
    words = [f"w{i}" for i in range(60)]
    own, turned, hub = kmers(" ".join(words)), kmers(" ".join(words[30:] + words[:30])), kmers("w1 w2 other")
    assert near_dups.sketch_beyond(own, hub) == near_dups.sketch_beyond(kmers("other " + " ".join(words)), hub)
    assert near_dups.sketch_beyond(own, hub) != near_dups.sketch_beyond(turned, hub)
    assert near_dups.sketch_beyond(hub, hub) == [] and len(near_dups.sketch_beyond(kmers("w1 new"), hub)) == near_dups.REFINED


def test_order_counts():
    import pyarrow as pa

    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join([f"w{i}" for i in range(30, 60)] + [f"w{i}" for i in range(30)])
    _, made = near_dups.sketch(pa.array([a, a, b]))
    assert (made[0] == made[1]).all() and (made[0] == made[2]).sum() < near_dups.SKETCHES


# licenses


def test_licenses(spark):
    random.seed(5)
    texts = ["MIT License, mit license; cc by CC-BY 4.0", "x" * 3000, "no Licence"]
    for notice in licenses.NOTICES:
        for _ in range(6):
            t = list(notice)
            for _ in range(random.randint(0, len(t) // licenses.PER_EDIT + 1)):
                t[random.randrange(len(t))] = random.choice(["", "q", "ab"])
            texts.append("Foo bar. " + "".join(t).title() + " baz")
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            parts = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += hits
            base |= {label} if hits else set()
        labels = base | {label for n, label in licenses.NOTICES.items() if regex.search(rf"(?:{n}){{e<={len(n) // licenses.PER_EDIT}}}", " ".join(words))}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and all(s.edits <= 12 and s.start < s.end for s in r.spans)


def test_edited_notice_before_an_exact_one():
    notice = "redistribution and use in source and binary forms with or without modification"
    edited = notice.replace("source", "sxurce").replace("binary", "bxnary")
    found = licenses.Scanner({notice: "bsd"}, licenses.PER_EDIT).find(f"{edited} {notice} {edited}")
    n = len(notice)
    assert [f[3] for f in found] == [2, 0, 2]
    assert [abs(f[1] - at) <= 2 for f, at in zip(found, (0, n + 1, 2 * n + 2), strict=True)] == [True] * 3


def test_all_notices_of_a_text(spark):
    """Each of many notices is one span, edited or not, close to each other or far, and the time grows with the text."""
    random.seed(9)
    word = lambda: "".join(random.choice("qxz") for _ in range(4))
    rows, want = [("released under the mit licence foo released under the mit license",), ("all rights reservd all rights reserved",)], [2, 2]
    for n in (1, 5, 40, 400):
        for filler in (0, 1, 9):
            parts = []
            for _ in range(n):
                notice = list("redistribution and use in source and binary forms with or without modification")
                for at in random.sample(range(20, 60), random.randrange(5)):
                    notice[at] = "x" if notice[at] != " " else " "
                parts += ["".join(notice), *[word() for _ in range(filler)]]
            rows.append((" ".join(parts),))
            want.append(n)
    rows, want = [*rows, ("Released under the MIT License, " * 30_000,)], [*want, 30_000]
    began = time.time()
    got = licenses.scan(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string")).select("doc_id", "n_words", "last_word", F.size("spans").alias("n"), "spans").collect()
    assert time.time() - began < 90
    assert [r.n for r in sorted(got, key=lambda r: r.doc_id)] == want
    last = max(got, key=lambda r: r.doc_id)
    assert all(rows[-1][0][s.start : s.end] == "Released under the MIT License" for s in last.spans) and last.last_word == 5 * 30_000 - 2


# packing


def test_packing(spark, texts):
    rows = packing.pack(_docs(spark)).collect()
    bpe = Tokenizer.from_file(byte_bpe.vocabulary_path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(p.ids for p in pieces), np.uint32).tolist()
        assert ids == [*bpe.encode(t, add_special_tokens=False).ids, 1]
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist() and n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
        total += n
    assert padding < 0.01 * total


def test_cuts():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        assert sum(packing.cuts(n)) == n


# media


def test_png_round_trip():
    for data in (b"", b"x", bytes(range(256)) * 20):
        payload = media.payload_of("") if not data else data + b"\xff" * (-len(data) % 576)
        stored = media.encode_png(payload)
        assert media.decode_png(stored).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_png(stored[:-20] + b"\0" * 20)


def test_interleaving():
    got = media.interleaved('<p>Hi &amp; x<img src="sha256:ab" alt="q"> after</p><figure><img src="u"><figcaption>Cap <b>t</b></figcaption></figure><script>no</script>end')
    assert got == [(0, "text", "Hi & x", None), (1, "media", "q", "sha256:ab"), (2, "text", "after", None), (3, "media", "Cap t", "u"), (4, "text", "end", None)]


def test_media_query(spark, texts):
    for r in media.op4_interleaved_media(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576) or b"\xff" * 576
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.caption == f"text of {r.doc_id}" and r.media_sha256 == hashlib.sha256(media.encode_png(payload)).hexdigest()


def test_hot_and_missing_payloads(spark):
    docs = spark.createDataFrame([(i, "hot") for i in range(300)] + [(300, None), (301, "cold")], "doc_id long, text string")
    ref = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    pages = [(i, f'<img src="{ref("hot")}" alt="a"><p>x</p><img src="{ref("hot")}" alt="b">') for i in range(300)] + [(300, f'<img src="{ref("")}">'), (301, f'<img src="{ref("cold")}"><img src="{ref("none")}"><img alt="no source">')]
    got = media.resolve(media.sequences(spark.createDataFrame(pages, "page_id long, html string")), docs).collect()
    by = collections.Counter((r.caption, r.digest, r.n_bytes) for r in got)
    digest = lambda t: ref(t).removeprefix("sha256:")
    assert by == {("a", digest("hot"), 3): 300, ("b", digest("hot"), 3): 300, ("", digest(""), 0): 1, ("", digest("cold"), 4): 1, ("", digest("none"), None): 1}
    assert all(r.position == (0 if r.caption == "a" else 2) for r in got if r.caption)


def test_payloads_without_ids_and_whole_sequences(spark):
    ref = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([(None, "no id"), (None, "no id"), (None, "other"), (1, "no id"), (1, "mine")], "doc_id long, text string")
    pages = spark.createDataFrame([(5, f'<p>before</p><img src="{ref("other")}" alt="o"><p>after</p><img src="{ref("mine")}" alt="m"><img src="{ref("no id")}">'), (6, None)], "page_id long, html string")
    parsed = media.sequences(pages)
    resolved = media.resolve(parsed, docs)
    assert sorted((r.position, r.n_bytes) for r in resolved.collect()) == [(1, 5), (3, 4), (4, 5)]
    whole = {r.doc_id: [(x.position, x.kind, x.text, x.digest) for x in r["items"]] for r in media.rejoin(parsed, resolved).collect()}
    digest = lambda t: ref(t).removeprefix("sha256:")
    assert whole == {5: [(0, "text", "before", None), (1, "media", "o", digest("other")), (2, "text", "after", None), (3, "media", "m", digest("mine")), (4, "media", "", digest("no id"))], 6: []}


# WARC


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    last = {}
    for p in pages:
        last[p.html] = max(last.get(p.html, -1), p.page_id)
    want = set()
    for p in pages:
        raw, own = (p.html or "").encode(), last[p.html] == p.page_id
        want.add((p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else last[p.html]))
    assert {tuple(r) for r in warc.op5_sequential_warc(spark, SF).collect()} == want


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "v", None), (4, "w", ""), (5, "é", "x" * 300_000), (6, "z", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(pages, str(tmp_path / "a"), least=1, archive=500)
    got = {r.record_id: r for r in warc.read(archives, str(tmp_path / "a"), piece=7).collect()}
    assert len(got) == 6
    assert got["urn:page:1"].refers_to == got["urn:page:2"].refers_to == "urn:page:6" and got["urn:page:6"].record_type == "response"
    assert got["urn:page:3"].record_type == got["urn:page:4"].record_type == "response"
    assert bytes(got["urn:page:5"].payload).decode() == "x" * 300_000 and got["urn:page:2"].target_uri == "urn:page:2"
    assert warc.write(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_warc_roles_by_page_and_payload(spark, tmp_path):
    rows = [(7, "u", "A only"), (7, "u", "dup"), (9, "u", "dup"), (None, "u", "dup"), (9, "u", "dup"), (None, "n", "alone")]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = collections.Counter((r.record_id, r.record_type, r.refers_to, bytes(r.payload or b"").decode()) for r in warc.read(archives, str(tmp_path / "a")).collect())
    revisit = lambda page: (f"urn:page:{page}", "revisit", "urn:page:9", "")
    assert got == {("urn:page:7", "response", None, "A only"): 1, revisit(7): 1, ("urn:page:9", "response", None, "dup"): 2, revisit(None): 1, ("urn:page:None", "response", None, "alone"): 1}


def test_warc_damage():
    good = warc.record("response", "u", "urn:page:1", b"abc", "2020-01-01T00:00:00Z")
    member = next(warc.members(iter([good])))
    assert warc.parse(member)[1] == b"abc"
    for bad in (member.replace(b"abc", b"abd"), member[:-2], member.replace(b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    with pytest.raises(warc.WarcError):
        list(warc.members(iter([good[:-5]])))
    assert len(list(warc.members(iter([good + good])))) == 2


# personal data


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and _luhn(digits(v))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    )
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])))


def test_pii(spark, texts):
    random.seed(3)
    parts = [*"0123456789" * 3, *"aA.@-+% ()_é\U0001f600", "4111 1111 1111 1111", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "DE89370400440532013000", "iban ", 'token = "', "186661156f3f9905942d70850a01cbf23a203f82"]
    made = ["".join(random.choice(parts) for _ in range(random.randrange(80))) for _ in range(500)] + ["1" * 30_000, "a" * 50_000 + "@", "1." * 20_000, "+1" * 9_000, "-1" * 9_000, *texts.values()]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.find(df).select("doc_id", pii._listed(F.filter("spans", lambda x: x["base"])).alias("base")).collect():
        assert r.base == _base_spans(made[r.doc_id])


def test_iban_before_and_among_other_groups(spark):
    iban, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    rows = [(0, f"{iban} BIC COBADEFF"), (1, f"{iban} 2024"), (2, f"AB12 {iban} {other} X"), (3, "DE89 3704 0044 0532 0130 01 BIC"), (4, f"é {iban}, {iban}")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in found}
    assert got == {0: [iban], 1: [iban], 2: [iban, other], 3: [], 4: [iban, iban]}


def test_many_spans_in_long_texts(spark):
    """As many matches as there are words, over many chunks, in a time that grows with the text."""
    rows = [(0, "12 " * 300_000), (1, "é a@b.co,1.2.3.4 " * 20_000), (2, "+1 555 123 4567;" * 5_000)]
    began = time.time()
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii._listed(F.filter("spans", lambda x: x["base"])).alias("base"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert time.time() - began < 90
    for r in found:
        assert r.base == _base_spans(rows[r.doc_id][1])
    assert {r.doc_id: r.clean for r in found} == {0: rows[0][1], 1: "é [EMAIL],[IP] " * 20_000, 2: "[PHONE];" * 5_000}


def test_pii_methods(spark):
    rows = [(0, "IBAN DE89370400440532013000."), (1, "DE88370400440532013000"), (2, "my ssn 123-45-6789"), (3, "123-45-6789"), (4, "mail a@b.co or 1.2.3.4")]
    got = {r.doc_id: (r.kinds, r.clean) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.transform("spans", lambda x: x["kind"]).alias("kinds"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert got == {0: (["iban"], "IBAN [IBAN]."), 1: ([], rows[1][1]), 2: (["ssn"], "my ssn [SSN]"), 3: ([], rows[3][1]), 4: (["email", "ip"], "mail [EMAIL] or [IP]")}


# tokens


def _strange(n):
    random.seed(1)
    alphabet = list("aAbB \n\t'sS<|endoftext|>éÉßΣσİ 12３中　\x1c\x85́!?#_-…\U0001f600") + ["<|endoftext|>", "<|startoftext|>", "</w>", "\n\n"]
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_automaton_like_the_library(texts):
    path = byte_bpe.vocabulary_path("word_bpe_49k.json")
    own, library = merge_automaton.word_bpe(path), Tokenizer.from_file(path)
    for t in [*list(texts.values())[:60], *_strange(800)]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == (np.array(ids, np.uint32).tobytes(), library.decode(ids, skip_special_tokens=False))


def test_automaton_against_merging():
    vocab = {t: i for i, t in enumerate(["a", "b", "a$", "b$", "aa", "ab", "aab", "ba", "aaaa", "ab$", "aab$"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("a", "b$"), ("aa", "b$")]
    automaton, rank = merge_automaton.MergeAutomaton(vocab, merges, "$"), {m: i for i, m in enumerate(merges)}
    random.seed(0)
    for _ in range(500):
        word = "".join(random.choice("ab") for _ in range(random.randrange(1, 14)))
        parts = [*word[:-1], word[-1] + "$"]
        while (pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]):
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert automaton.encode(word) == [vocab[p] for p in parts]


def test_byte_ids_like_the_library(texts):
    own, library = byte_bpe.gpt_bytes(), Tokenizer.from_file(byte_bpe.vocabulary_path("byte_bpe_50k.json"))
    for t in [*list(texts.values())[:60], *_strange(800)]:
        assert own.array(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_attribution(spark, texts):
    made = dict(enumerate([*_strange(200), "", "\n", "a\n\n\nb", *texts.values()]))
    got = collections.defaultdict(list)
    for r in token_counts.attribute(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect():
        got[r.doc_id].append(tuple(r)[1:])
    bpe = byte_bpe.gpt_bytes()
    for i, t in made.items():
        edges = [0]
        for line in re.findall("[^\n]*\n|[^\n]+", t) or [""]:
            edges.append(edges[-1] + len(line))
        starts = [len(t[:e].encode()) for e in edges]
        count, cross, at, ids = [0] * (len(edges) - 1), [0] * (len(edges) - 1), 0, bpe.array(t)
        for x in ids:
            own = bisect.bisect_right(starts[:-1], at) - 1
            at += int(bpe.byte_lengths[x])
            count[own] += 1
            cross[own] += at > starts[own + 1]
        assert sorted(got[i]) == [(j, edges[j], edges[j + 1], count[j], cross[j], len(ids)) for j in range(len(edges) - 1)]


# quality


def test_quality_statistics(spark, texts):
    for r in quality.op8_hashed_llr_quality(spark, SF).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not r.base_failed or not r.kept)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    made = quality.score(docs.select("doc_id", "text"), quality.fit(docs.select("doc_id", "text"), labels.filter("doc_id % 2 = 0")))
    held = made.filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_document_with_two_labels_is_good_only_by_both(spark):
    good, bad = " ".join(f"g{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(0, 40, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.doc_id % 2: r.kept for r in quality.quality_rules(docs, labels).collect()} == {0: False, 1: True}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "few words")], "doc_id long, text string")
    for labels in (None, spark.createDataFrame([], "doc_id long, quality int")):
        assert {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()} == {1: True, 2: False}


# substrings


def _removed(rows):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        yield d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def _passages():
    random.seed(2)
    shared = [[random.choice("abcdefgh") for _ in range(40)] for _ in range(5)]
    piece = lambda: random.choice([random.choice(shared)[random.randrange(20) :], [random.choice("ab")] * random.randrange(20), [random.choice("xyzuvwé") for _ in range(15)]])
    return [(d, " ".join(sum((piece() for _ in range(random.randrange(8))), [])) or random.choice([None, "", "  \n"])) for d in random.sample(range(1000), 200)]


def test_substrings(spark):
    rows = _passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.deduplicate(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == sorted(_removed(rows))
    words, by_id = {d: WORD.findall(t or "") for d, t in rows}, {r.doc_id: r for r in found}
    for r in found:
        for s in r.spans:
            assert s.length >= 13 and words[r.doc_id][s.start : s.start + 13] == words[s.source][s.source_start : s.source_start + 13]
    for r in substrings.deduplicate(df, form="cut").collect():
        assert WORD.findall(r.kept) == by_id[r.doc_id].kept.split()


def test_edges_of_one_hash_and_other_words(spark):
    """With a hash of a few bits unlike windows collide; coordinates tell them apart, and the result is the same."""
    rows = _passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = df.select(F.pmod("doc_id", F.lit(3)).alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert substrings.unverified(substrings.placed(blocks, Scratch(spark), 13, 5)).count() == 0
    assert substrings.unverified(substrings.placed(blocks, Scratch(spark), 13, 5, 0, 6)).count() > 0
    found = substrings.deduplicate(df, bits=6).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == sorted(_removed(rows))


def test_rows_of_one_id(spark):
    passage, more = [f"p{i}" for i in range(30)], [f"q{i}" for i in range(30)]
    rows = [(1, " ".join(passage)), (1, " ".join(more)), (2, " ".join(["x"] * 3 + passage + more)), (None, " ".join(more)), (1, " ".join(more))]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == sorted([(1, 30, rows[0][1]), (1, 30, rows[1][1]), (1, 30, rows[1][1]), (2, 63, "x x x"), (0, 30, "")])


def test_paths(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(20)]
    rows = [(0, " ".join(a[:30])), (1, " ".join(a[10:])), (2, " ".join(a)), (3, " ".join(b)), (4, " ".join(b)), (5, " ".join(f"c{i}" for i in range(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.placed(df.selectExpr("doc_id % 2 AS block", "doc_id", "text"), Scratch(spark), 13, 5)
    made = substrings.compact(found.filter("kind = 'segment'").select("source", "start", "length", "first", "last"), Scratch(spark)).collect()
    by_path = collections.defaultdict(list)
    for r in made:
        by_path[r.path].append((r.offset, r.length))
    assert sorted(map(sorted, by_path.values())) == [[(0, 8)], [(0, 18), (18, 10)]]  # 40 and 20 words have so many windows
    spans = {r.doc_id: [(s.start, s.length, s.source, s.path_start) for s in r.spans] for r in substrings.deduplicate(df).collect()}
    assert spans == {0: [], 1: [(0, 20, 0, 10)], 2: [(0, 40, 0, 0)], 3: [], 4: [(0, 20, 3, 0)], 5: []}


def test_circles_end(spark):
    rows = [(i, " ".join(["a", "b"] * 20)) for i in range(3)] + [(9, " ".join(["b", "a"] * 30))]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(_removed(rows))


def test_pipeline(spark, tmp_path):
    """Each stage's rows against plain Python on the rows of the one before."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, rows = _docs(spark), {}
    rows["documents"] = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            rows[name] = {r.doc_id: r for r in docs.collect()}
            assert len(rows[name]) == docs.count() and all(r.n_chars == len(r.text) for r in rows[name].values())
    same = lambda after, before: all(rows[before][i] == r for i, r in rows[after].items())

    verdicts = {r.doc_id for r in quality.op8_hashed_llr_quality(spark, SF).filter("kept").collect()}
    assert set(rows["quality"]) == verdicts and same("quality", "documents")

    own = {i: r.text.split() for i, r in rows["quality"].items()}
    assert same("near_dedup", "quality")
    for i in set(own) - set(rows["near_dedup"]):  # whoever went is near to one that is before it
        assert any(j < i and near_dups.similarity(own[i], own[j], 0.8) is not None for j in own)
    left = sorted(rows["near_dedup"])
    assert len({" ".join(own[i]) for i in left}) == len(left)

    cut = {i: WORD.findall(r.text) for i, r in rows["substring_dedup"].items()}
    want = {i: kept.split() for i, _, _, kept in _removed([(i, rows["near_dedup"][i].text) for i in left])}
    assert cut == want

    for i, r in rows["pii"].items():
        before = rows["substring_dedup"][i].text
        spans = [x.split(":") for x in _base_spans(before).split(",") if x]
        assert r.lang == rows["substring_dedup"][i].lang and (r.text == before or "[" in r.text)
        assert all(before[int(a) : int(b)] not in r.text for k, a, b in spans if k in ("email", "card"))

    bpe = Tokenizer.from_file(byte_bpe.vocabulary_path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        assert r.ids_crc32 == zlib.crc32(r.ids)
    assert {i: np.frombuffer(b"".join(x for _, x in sorted(p)), np.uint32).tolist() for i, p in pieces.items()} == {i: [*bpe.encode(r.text, add_special_tokens=False).ids, 1] for i, r in rows["pii"].items()}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))
