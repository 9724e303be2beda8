"""Readers, sinks, remote calls and streams."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from wordloom.operators import matching, mining, pairing, remote, terms, trace
from wordloom.sources import articles, exports
from wordloom.streaming import traces

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_articles(spark, tmp_path):
    good = {"title": "A &amp; B", "description": 5, "content": "كتاب &lt;x&gt;"}
    for name, body in (("a.json", json.dumps(good)), ("b.json", "[1]"), ("c.json", "{bad"), ("d.json", '{"content": null}'), ("e.txt", "no")):
        (tmp_path / name).write_text(body, encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in articles.read_articles(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "A & B كتاب <x>", "b.json": "", "c.json": "", "d.json": ""}
    assert articles.read_articles(spark, str(tmp_path), first=2).count() == 2


def test_entries(spark, tmp_path):
    (tmp_path / "terms-law.json").write_text(json.dumps([{"ar": "ا", "en": "x"}, {"ar": "ب", "en": "y"}]), encoding="utf-8")
    (tmp_path / "terms-art.json").write_text(json.dumps({"pairs": [{"ar": "ج", "en": "z"}], "domain": "art"}), encoding="utf-8")
    read = lambda n: [tuple(r) for r in articles.read_entries(spark, str(tmp_path / n), "ar string, en string").orderBy("ord").collect()]
    assert read("terms-law.json") == [(0, "ا", "x"), (1, "ب", "y")]
    assert read("terms-art.json") == [(0, "ج", "z")]
    assert [r.domain for r in articles.discover(spark, str(tmp_path), "terms").collect()] == ["art", "law"]
    with pytest.raises(FileNotFoundError, match="terms-art"):
        articles.read_or_empty(spark, str(tmp_path / "none.json"), "ar string")
    assert articles.read_or_empty(spark, str(tmp_path / "none.json"), "ar string", strict=False).count() == 0


def test_sinks(spark, tmp_path):
    rows = [(2, "b\tb", "ب", "law", 3, None), (1, "a<&|", "ا", "art", 9, "high")]
    pairs = spark.createDataFrame(rows, "position long, en string, ar string, domain string, corpus_freq long, confidence string")
    read = lambda n: "".join(p.read_text() for p in sorted((tmp_path / n).glob("part-*"))).splitlines()
    want = ["en\tar\tdomain\tcorpus_freq\tconfidence", "a<&|\tا\tart\t9\thigh", "b b\tب\tlaw\t3\tmedium"]
    for n, rows in (("t", 100), ("t2", 1)):
        exports.write_lines(exports.tsv(pairs), str(tmp_path / n), rows=rows)
        assert read(n) == want
    exports.write_lines(exports.tbx(pairs), str(tmp_path / "x"))
    entries = ElementTree.fromstringlist(read("x")[1:]).findall(".//termEntry")
    assert [(e.get("id"), [d.text for d in e.findall("descrip")], [t.text for t in e.iter("term")]) for e in entries] == [("term-1", ["art", "high", "9"], ["a<&|", "ا"]), ("term-2", ["law", "medium", "3"], ["b\tb", "ب"])]
    exports.write_lines(exports.json_array(pairs, ("en", "ar", "corpus_freq", "confidence")), str(tmp_path / "a"))
    listed = [{"en": "a<&|", "ar": "ا", "corpus_freq": 9, "confidence": "high"}, {"en": "b\tb", "ar": "ب", "corpus_freq": 3, "confidence": None}]
    assert "\n".join(read("a")) == json.dumps(listed, ensure_ascii=False, indent=2)
    assert "a<&\\|" in exports.markdown(pairs, ("en",)).filter("position = 1").first().line
    for name, form in (("full", "tsv"), ("minimal", "json")):
        with pytest.raises(ValueError):
            exports.view_lines(pairs, name, form)
    exports.write_domains(pairs, str(tmp_path / "d"), least=1)
    assert sorted(p.name for p in (tmp_path / "d").glob("domain=*")) == ["domain=art", "domain=law"]
    exports.write_domains(pairs, str(tmp_path / "d2"), ["law"], 1)
    assert sorted(p.name for p in (tmp_path / "d2").glob("domain=*")) == ["domain=law"]
    exports.write_json(pairs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def _transport(answers):
    answers = iter(answers)

    def send(vendor, payload, timeout):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return send


OK = (200, '{"content": "hi"}')


@pytest.mark.parametrize(
    ("answers", "kind", "attempts"),
    [([OK], None, 1), ([(503, ""), OK], None, 2), ([(401, "")], "auth", 1), ([(404, "")], "http_4xx", 1), ([(200, "no json")], "parse", 1), ([(200, "{}")], "empty_response", 1), ([TimeoutError()] * 3, "timeout", 3), ([OSError("x")] * 3, "network", 3), ([(500, "")] * 3, "http_5xx", 3), ([RuntimeError()] * 3, "unknown", 3)],
)
def test_remote_call(answers, kind, attempts):
    made = remote.call("v", {"a": 1}, _transport(answers), remote.Breaker(), sleep=lambda s: None)
    assert (made["ok"], made["error_class"], made["attempts"]) == (kind is None, kind, attempts)


def test_pairing_end_to_end(spark):
    def vendor_answer(vendor, prompt, timeout):
        """Proposes for each numbered term; the second vendor agrees on some, and a batch with "bad" in it fails."""
        if "bad" in prompt:
            return 401, ""
        named = [line.split(" ")[1] for line in prompt.splitlines()]
        made = [{"ar": t, "en": f"{t} word" if vendor == "one" or t < "c" else "other", "confidence": "low" if t == "a" else "medium"} for t in named]
        return 200, json.dumps({"content": f"Here: {json.dumps(made)}"})

    rows = [(i + 1, t, 9 - i, "unigram") for i, t in enumerate(["a", "b", "c", "d", "bad", "e"])]
    candidates = spark.createDataFrame(rows, "rank long, term string, freq long, ngram_size string")
    pairs = {r.ar: (r.en, r.confidence, r.corpus_freq, r.proposer) for r in pairing.pair(candidates, "one", vendor_answer, size=4).collect()}
    assert pairs == {t: (f"{t} word", "medium", 10 - n, "one") for n, t in ((2, "b"), (3, "c"), (4, "d"))}
    assert [r.ar for r in pairing.pair(candidates, "one", vendor_answer, size=4, most=2).collect()] == ["b"]
    both = {r.ar: (r.confidence, r.cross_agreement, r.disagreement_alt_en) for r in pairing.pair(candidates, "one", vendor_answer, "two", 4).collect()}
    assert both == {"b": ("high", True, None), "c": ("medium", False, "other"), "d": ("medium", False, "other")}


def test_many_phrases(spark):
    docs = spark.createDataFrame([(1, "One two, three_x w7"), (2, "w7 one"), (3, None)], "doc_id long, text string")
    phrases = ["one", "two, three", "", "One", "none"] + [f"filler{'x' * i}" for i in range(matching.FEW_PHRASES + 1)] + ["w7"]
    got = sorted(tuple(r) for r in matching.phrase_hits(docs, phrases).collect())
    want = [(1, 1, "one"), (1, 4, "One"), (1, len(phrases), "w7"), (2, 1, "one"), (2, 4, "One"), (2, len(phrases), "w7")]
    assert got == want


def test_numbering_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(terms, "PLACES", 3)
    rows = [(f"t{i}", i % 4, i % 3, i) for i in range(60)]
    made = terms.numbered(spark.createDataFrame(rows, "ar string, corpus_freq long, domain_ord long, ord long").selectExpr("ar", "corpus_freq", "struct(domain_ord, ord) AS seen"))
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[3]))]
    assert [r.ar for r in made.orderBy("position").collect()] == want and sorted(r.position for r in made.collect()) == list(range(1, 61))


def test_breaker_and_fallback():
    now = [0.0]
    breaker = remote.Breaker(clock=lambda: now[0])
    fail = lambda: remote.call("v", "x", _transport([(404, "")]), breaker)
    assert [fail()["error_class"] for _ in range(4)] == ["http_4xx"] * 3 + ["circuit_open"]
    assert remote.call("v", {1: object()}, _transport([]), remote.Breaker())["error_class"] == "payload_encode"
    now[0] = 61
    assert remote.call("v", "x", _transport([OK]), breaker)["ok"]
    both = remote.call_with_fallback("a", "b", "x", _transport([(404, ""), OK]), remote.Breaker())
    assert both["ok"]
    neither = remote.call_with_fallback("a", "b", "x", _transport([(404, ""), (401, "")]), remote.Breaker())
    assert neither["error_class"] == "http_4xx"


def test_remote_batches(spark):
    def send(vendor, payload, timeout):
        return (200, '{"content": "ok"}') if payload == "good" else (404, "")

    df = spark.createDataFrame([(1, "v", "good"), (2, "v", "bad")], "id long, vendor string, payload string")
    assert {r.id: r.ok for r in remote.call_all(df, send).collect()} == {1: True, 2: False}


def _stream(spark, tmp_path, n=400):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(n).select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def _drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_numbers_like_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    got = sorted(map(tuple, _drain(traces.numbered(stream), "numbered").collect()))
    want = sorted((r.trace_id, r.event_id, r.seq) for r in trace.records(batch).collect())
    assert got == want


def test_stream_hourly_like_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    got = sorted(map(tuple, _drain(traces.hourly(stream), "hourly", "complete").collect()))
    assert got == sorted(map(tuple, trace.hourly(batch).collect()))


def test_stream_breaker(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    want, state = [], {}
    for r in sorted(batch.collect(), key=lambda r: (r.ts, r.event_id)):
        failures, until = state.get(r.user_id, (0, 0.0))
        now = r.ts.timestamp()
        if now < until:
            want.append((r.user_id, r.event_id, True, False))
            continue
        if until:
            failures, until = 0, 0.0
        failures = failures + 1 if r.event_type == "error" else 0
        opened = failures >= 2
        state[r.user_id] = (failures, now + 60 if opened else until)
        want.append((r.user_id, r.event_id, False, opened))
    assert sorted(map(tuple, _drain(traces.breaker(stream, most=2), "breaker").collect())) == sorted(want)


def test_incremental_mining(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["كتاب جديد", "كتاب جديد قديم", "بيت كتاب"])], "doc_id long, text string")
    for i in range(3):
        docs.filter(F.col("doc_id") == i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    traces.mine_incrementally(stream, str(tmp_path / "counts"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, traces.merged(spark, str(tmp_path / "counts")).collect()))
    assert got == sorted(map(tuple, mining.frequencies(mining.occurrences(docs)).collect()))


def test_trace_round_trip(spark):
    made = trace.records(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    back = trace.from_json(trace.as_json(made), ", ".join(f"{c} {t}" for c, t in made.dtypes))
    assert back.select(*made.columns).exceptAll(made).count() == 0


def test_vote_table(spark):
    cols = ", ".join(f"{v}_agree boolean, {v}_alt string" for v in terms.VENDORS)
    df = spark.createDataFrame([("a", True, None, False, "x", None, None, True, None)], f"ar string, {cols}")
    assert sorted((r.vendor, r.agree) for r in terms.vote_table(df).collect()) == [("codex", True), ("gemini", False), ("minimax", True)]
