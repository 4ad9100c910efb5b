import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlore.llm import licenses, mixing, rules
from gridlore.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def _compare(df, sql, table, tmp_path):
    folder = tmp_path / "oracle"
    folder.mkdir()
    pq.write_table(table.toArrow(), folder / "documents.parquet")  # ids beside nulls stay whole numbers
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(sql, str(folder))


def test_rules_on_odd_rows(docs, odd_rows, tmp_path):
    t = docs([*odd_rows, (20, "one two three four five six seven eight nine ten"), (21, "a b c d e f " * 5), (22, "x y\nx y\nx y\n" * 2), (23, "# $ % & word " * 9), (24, "LOUD WORDS!! " * 9)])
    df = rules.apply_policy(rules.ledger(t))
    chosen = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(3)) != 0).alias("base_failed"), "kept", "fail_bits")
    _compare(chosen, rules.OP7_SQL, t, tmp_path)


def test_ablations(docs):
    t = docs([(k, text) for k, text in enumerate(["one two three four five six seven eight nine ten"] * 3 + ["few"] * 2 + ["# $ % & plain words of some length here again"])])
    led = rules.ledger(t)
    rows = {(r["version"], r["rule"]): r for r in rules.ablations(led).collect()}
    masks = [r["fail_bits"] for r in led.collect()]
    for (version, rule), r in rows.items():
        m, b = rules.mask(version), rules.BIT[rule]
        assert r["failed"] == sum(bool(x & b) for x in masks) and r["only"] == sum((x & m) == b for x in masks)
        assert r["kept"] == sum(not x & m for x in masks) and r["kept_without"] == sum(not x & m & ~b for x in masks)


def test_rules_on_an_empty_table(docs):
    assert rules.ablations(rules.ledger(docs([]))).count() == 0


MIT = next(t for n, t in licenses.KNOWN if n == "MIT")


def test_licences(docs, odd_rows, tmp_path):
    t = docs([
        *odd_rows,
        (30, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + MIT.replace("sublicense", "sub-licence").upper()),
        (31, "prose here\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0.\nmore"),
        (32, "Released under the MIT License."),
        (33, MIT[:-30]),
    ])
    df = licenses.scan(t)
    rows = {r["doc_id"]: r for r in df.where("doc_id >= 30").collect()}
    assert rows[30]["text_license"] == "MIT" and rows[30]["n_notices"] == 1
    assert (rows[31]["text_license"], rows[31]["notice_licenses"], rows[31]["n_notices"]) == ("", "CC-BY-NC-4.0,MIT", 2)
    assert (rows[32]["text_license"], rows[32]["notice_licenses"], rows[32]["n_notices"]) == ("MIT", "MIT", 1)
    assert (rows[33]["text_license"], rows[33]["n_notices"]) == ("", 0)
    _compare(df, licenses.OP3_SQL, t, tmp_path)


def test_licence_terms_at_the_start_of_a_line(docs):
    """Every known text, wrapped at any width, is what it is on one line."""
    import textwrap

    texts = [(n, w, t) for n, t in licenses.KNOWN for w in (12, 20, 40, 57, 65, 72, 80) if len(t) > 200]
    wrapped = [textwrap.fill(t, w, break_long_words=False, break_on_hyphens=False) for _, w, t in texts]
    assert any(re.search("(?im)^copyright (notice|holders)", t) for t in wrapped)
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    usual = "Copyright (c) 2020 Someone\n\n" + isc + next(t for n, t in licenses.KNOWN if n == "ISC").split("in all copies. ")[1]
    found = {r["doc_id"]: r["text_license"] for r in licenses.scan(docs([(-1, usual), *enumerate(wrapped)])).collect()}
    assert found.pop(-1) == "ISC"
    assert found == {k: n for k, (n, _, _) in enumerate(texts)}


@pytest.mark.parametrize(("line", "dropped"), [
    ("Copyright (c) 2020 Someone", True), (" * Copyright 2020, Someone", True), ("COPYRIGHT \xa9 SOMEONE", True), ("Copyright The Some Authors", True), ("copyright jane doe", True),
    ("Copyright 李明", True), ("(C) Someone", True), ("\xa9 2020", True), ("All rights reserved.", True), ("Copyright notice (c) 2020 Someone", True),
    ("copyright notice and this permission notice", False), ("COPYRIGHT HOLDERS BE LIABLE", False), ("copyright owner or", False), ("copyright", False), ("(c) You must retain", False),
    ("copyright licence to", False), ("copyright the software, and", False), ("Copyrighted 2020", False), ("about copyright 2020", False),
])
def test_copyright_lines(docs, line, dropped):
    forms = docs([(1, line)]).select(licenses.line_forms(F.col("text")).alias("forms")).first()["forms"]
    assert (forms == []) is dropped


def test_texts_of_all_scripts_count(docs, tmp_path):
    t = docs([(1, "这是一份中文许可。Licensed under CC BY 4.0."), (2, "第一份文本"), (3, "第二份文本"), (4, "नमस्ते"), (5, "नमसते"), (6, "Été\nLicensed under CC BY 4.0.")])
    rows = {r["doc_id"]: r for r in licenses.scan(t).collect()}
    assert (rows[1]["text_license"], rows[1]["n_notices"]) == ("", 0) and rows[6]["notice_licenses"] == "CC-BY-4.0"
    assert len({r["canonical_sha256"] for r in rows.values()}) == 6
    _compare(licenses.scan(t), licenses.OP3_SQL, t, tmp_path)


@pytest.mark.parametrize(("name", "file"), [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licence_texts(docs, name, file):
    from pathlib import Path

    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("the licence's text is not on this machine")
    text = path.read_text(encoding="utf-8")
    rows = licenses.scan(docs([(1, text), (2, " ".join(text.upper().split(" "))), (3, text.replace("the", "a", 1))])).collect()
    assert {r["doc_id"]: r["text_license"] for r in rows} == {1: name, 2: name, 3: ""}


def test_notices_are_the_same_in_the_oracle(docs, tmp_path):
    lines = ["Copyright (c) 2020 Someone", "copyright notice and this", "Copyright notice (c) 2020 Someone", "(C) Someone", "(c) You must retain", "copyright", "copyright the software, and", "Copyright 李明", "\xa9 2020", "All Rights Reserved", "Copyrighted 2020", "copyright \xa9"]
    t = docs(list(enumerate(lines)))
    _compare(licenses.scan(t), licenses.OP3_SQL, t, tmp_path)


def test_mix_on_odd_rows(docs, odd_rows, tmp_path):
    rows = [(*r, None if k % 3 == 0 else f"s{k % 3}") for k, r in enumerate(odd_rows)] + [(100 + k, "w " * (k % 40), "big") for k in range(300)]
    t = docs(rows)
    df = mixing.mix(t)
    assert df.count() == len(rows)
    assert df.where("taken > 2 * size or copies < 0").count() == 0
    _compare(df.drop("__rid"), mixing.OP2_SQL, t, tmp_path)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1], [0, 0, 0], [5], [7, 3, 100, 2, 2, 900]])
def test_targets_equal_resharing_by_hand(spark, sizes):
    sources = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    weight = {f"s{k}": (3, 1, 2)[k % 3] for k in range(len(sizes))}
    limit = {f"s{k}": 2.0 * n for k, n in enumerate(sizes)}
    target, rest, free = dict.fromkeys(weight, 0.0), 1.5 * sum(sizes), set(weight)
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= limit[s]}
        target |= {s: limit[s] for s in over} | ({} if over else share)
        rest -= sum(limit[s] for s in over)
        free -= over or free
    assert found == pytest.approx(target)


def test_mix_is_the_same_every_time_and_near_its_targets(docs):
    t = docs([(k, "w " * (k * 37 % 211), f"s{k % 4}") for k in range(5000)])
    one, two = ([tuple(r) for r in mixing.mix(t).orderBy("doc_id").collect()] for _ in range(2))
    assert one == two
    sums = mixing.mix(t).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in sums)


def test_rows_without_ids_and_repeated_rows_draw_apart(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    t = docs([(None, f"w {k % 3} " * 5, "a") for k in range(900)] + [(7, "w " * 5, "a")] * 300 + [(k, "w " * 9, "b") for k in range(300)])
    one, two = (sorted((bytes(r["__rid"]), r["copies"], r["doc_id"] == 7) for r in mixing.mix(t).collect()) for _ in range(2))
    # Every row has one certain copy; a second one is drawn, by each of the repeated rows for itself.
    assert one == two and len({rid for rid, _, _ in one}) == 1500 and {n for _, n, _ in one} == {1, 2}
    assert 300 < sum(n > 1 for _, n, _ in one) < 1200 and 0 < sum(n > 1 for _, n, seven in one if seven) < 300
    _compare(mixing.mix(t).drop("__rid"), mixing.OP2_SQL.replace("drawn // 2000", "drawn // 50"), t, tmp_path)


def test_mix_over_many_buckets(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    t = docs([(k, "w " * (k % 97), "a" if k % 3 else "b") for k in range(2000)])
    _compare(mixing.mix(t).drop("__rid"), mixing.OP2_SQL.replace("drawn // 2000", "drawn // 50"), t, tmp_path)


def test_empty_tables(docs):
    assert mixing.mix(docs([])).count() == 0 and licenses.scan(docs([])).count() == 0


def test_native_plans_have_no_python(spark, sf):
    for name in ("op2_pareto_mix", "op3_license_digests"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_extra_columns_may_clash(stored, spark):
    t = stored([(1, "one two", "x", 5, "y"), (2, "three", "x", 6, "z")], "doc_id long, text string, source string, size long, shard string")
    from gridlore.llm import ngram_join, packing, passages, quality, sharding, toxicity

    assert mixing.mix(t).count() == licenses.scan(t).count() == rules.ledger(t).count() == 2
    assert sharding.shard_documents(t).count() == ngram_join.ngram_join(t).count() == 2
    assert set(ngram_join.keep_one(t).columns) == set(t.columns)
    assert set(passages.dedup_passages(t.withColumn("spans", F.lit("x"))).columns) == {*t.columns, "spans"}
    model = toxicity.OrdinalModel(*(__import__("numpy").zeros(0, d) for d in ("i8", "f8")), __import__("numpy").array([10.0, 20.0, 30.0]))
    assert toxicity.severity(t, model).count() == 2 and toxicity.clean_only(t, model).columns == t.columns
    assert packing.pack_documents(t, *packing.byte_bpe()).count() == 2
    assert quality.score(t, quality.fit([])).count() == 2
