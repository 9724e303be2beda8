"""Readers of assets."""

import json
import os

import pytest

from wordloom.sources import assets


def test_statistics(spark, tmp_path):
    body = {"categories": {"news": {"n_records": 3, "mean_sentence_length": 2.5, "sentence_length_histogram_pct": {"1-5": 60.0, "6-10": 40.0}, "top_connectors": [["and", 5], ["odd"], ["but", 2]], "top_sent_initial_tokens": [["the", 4]]}, "old": {"n_records": 1, "top_sentence_starters": [["a", 1]]}}}
    (tmp_path / "s.json").write_text(json.dumps(body))
    stats = assets.category_stats(spark, str(tmp_path / "s.json"))
    assert {r.category: r.n_records for r in stats.collect()} == {"news": 3, "old": 1}
    assert [tuple(r) for r in assets.top_connectors(stats).orderBy("rank").collect()] == [("news", 1, "and", 5), ("news", 3, "but", 2)]
    assert assets.top_connectors(stats, 1).count() == 1 and assets.top_starters(stats).count() == 2 and assets.histogram(stats).count() == 2
    assert assets.category_stats(spark, str(tmp_path / "s.json"), "news").count() == 1
    with pytest.raises(assets.StatsError, match="news, old"):
        assets.category_stats(spark, str(tmp_path / "s.json"), "classical")


def test_registry(spark, tmp_path):
    body = {"assets": {"a": {"current_version": "1.2.0", "compatibility": "^1.0.0", "breaking_versions": []}, "b": {"current_version": "2.0.0", "compatibility": "^2.0.0"}}, "consumer_declared_requirements": {"x": {"asset_requirements": {"a": "^1.1.0", "b": "^1.0.0", "c": "^1.0.0"}}}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    got = {r.asset_id: r.status for r in assets.check_consumer(spark, str(tmp_path / "r.json"), "x").collect()}
    assert got == {"a": "ok", "b": "incompatible", "c": "missing"}
    assert assets.check_consumer(spark, str(tmp_path / "r.json"), "nobody").count() == 0


def test_rule_tables(spark, tmp_path):
    body = {"tables": {"phrases": {"policy": "replace", "entries": [{"input": "x", "alternatives": ["y", ""]}, {"input": "z"}]}, "swaps": {"policy": "swap", "probability": 0.7, "entries": [{"input": "a", "replacement": "b", "source_tag": "v2"}]}}}
    (tmp_path / "t.json").write_text(json.dumps(body))
    rows = {(r.table_name, r.ord): (r.input, r.alternatives, r.replacement, r.probability) for r in assets.rule_tables(spark, str(tmp_path / "t.json")).collect()}
    assert rows == {("phrases", 0): ("x", ["y", ""], None, None), ("phrases", 1): ("z", None, None, None), ("swaps", 0): ("a", None, "b", 0.7)}


def test_accessors(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
        return str(tmp_path / name)

    stats = assets.Statistics(spark, put("s.json", {"input": "x", "sample_size": 5, "categories": {"news": {"n_tokens": 7, "burstiness": 0.5}}}), ("news", "law"))
    assert stats.metadata() == {"input": "x", "sample_size": "5", "skipped": None, "elapsed_s": None}
    assert stats.number("news", "n_tokens") == 7 and stats.number("news", "mean_sentence_length") == 0
    with pytest.raises(assets.StatsError):
        stats.category("law")
    with pytest.raises(KeyError):
        stats.category("poetry")

    path = put("r.json", {"assets": {"b": {"current_version": "2.0.0", "compatibility": "^2.0.0"}, "a": {"current_version": "1.2.0", "compatibility": "^1.0.0", "breaking_versions": ["1.1.0"]}}, "consumer_declared_requirements": {"x": {"asset_requirements": {"a": "^1.1.0"}}}})
    registry = assets.Registry(spark, path)
    assert registry.assets() == ["a", "b"] and registry.version() == "unknown" and registry.required_for("x") == {"a": "^1.1.0"}
    assert registry.asset("a") == ("1.2.0", "^1.0.0", ["1.1.0"]) and registry.asset("b") == ("2.0.0", "^2.0.0", [])
    for unknown in (registry.asset, registry.required_for):
        with pytest.raises(KeyError, match="nobody"):
            unknown("nobody")
    put("r.json", {"$registry_version": "1.1.0", "assets": {}})
    os.utime(path, (1, 1))
    assert registry.version() == "1.1.0" and registry.assets() == []

    tables = assets.RuleTables(spark, put("t.json", {"$schema_version": "1.0.0", "tables": {"numbered_transitions": {"probability": 0.5, "entries": [{"input": "first", "replacement": "to begin"}]}, "repetitive_starters": {"detectors": ["and", "so"], "replacements": ["then"]}}}))
    assert tables.schema_version() == "1.0.0" and tables.names() == ["numbered_transitions", "repetitive_starters"]
    assert tables.replacements("numbered_transitions") == [("first", "to begin")] and tables.listed("repetitive_starters", "detectors") == ["and", "so"]
    with pytest.raises(KeyError, match="numbered_transitions, repetitive_starters"):
        tables.table("none")

    entries = assets.Entries(spark, put("d.json", {"pairs": [{"ar": "ب", "en": "b"}, {"ar": "", "en": "x"}, {"ar": "ا", "en": "a"}]}))
    assert entries.count() == 3 and entries.patterns("ar") == ["ب", "ا"] and entries.patterns("en") == ["b", "x", "a"]
    (tmp_path / "text.txt").write_text("ab ba", encoding="utf-8")
    assert sorted(tuple(r)[:3] for r in assets.scan_files(spark, str(tmp_path / "text.txt"), ["a", "ba"]).collect()) == [(0, 1, "a"), (3, 5, "ba"), (4, 5, "a")]


def test_health(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"$schema_version": "1.0.0", "entries": [1, 2, 3]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1]")

    def probe(vendor):
        if vendor == "off":
            raise OSError("refused")
        return vendor == "on"

    files = {n: str(tmp_path / f"{n}.json") for n in "abcd"}
    got = [tuple(r) for r in assets.health_report(spark, files, {"a": "entries"}, ("on", "off", "ill"), probe).drop("path").collect()]
    assert got == [("a", "OK", 50, 3, "1.0.0"), ("b", "UNREADABLE", 7, None, None), ("c", "OK", 3, None, None), ("d", "MISSING", None, None, None), ("on", "OK", None, None, None), ("off", "UNREACHABLE", None, None, None), ("ill", "UNREACHABLE", None, None, None)]
