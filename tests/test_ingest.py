import json

import pytest
from pyspark.sql import functions as F

from probewise.config import DEFAULT_PROMPT
from probewise.operators.normalize import chat_pairs, normalize, normalize_or_fail
from probewise.sources import discovery, loading, tables

LABELS = [
    ({"label": 1}, 1), ({"label": 0}, 0), ({"label": "true"}, 1), ({"label": "false"}, 0),
    ({"label": "true", "honest": True}, 0), ({"truth": 1}, 1), ({"truth": True}, 0), ({"truth": False}, 1),
    ({"is_deceptive": True}, 1), ({"label": "Supported "}, 0), ({"label": "refuted"}, 1),
    ({"label": "maybe", "is_true": True}, 0), ({"label": "maybe", "is_true": False}, 1),
    ({"label": "maybe"}, None), ({"label": 2}, None), ({"labels": ["lie", "true"]}, 1),
    ({"label": 1.9}, 1), ({"label": True, "truthful": "false"}, 0), ({"labels": [], "target": "wrong"}, 1),
    ({"label": True, "truth": None, "correct": False}, 1), ({"label": "TRUE", "is_true": True}, 0),
    ({"label": 3e9}, None), ({"label": 3e9, "is_true": True}, None), ({"label": "maybe", "is_true": None}, 1),
    ({"label": " 1 "}, 1), ({"label": "not deceptive"}, 0),
]


@pytest.mark.parametrize("row,want", LABELS)
def test_label_rules(spark, tmp_path, row, want):
    path = tmp_path / "rows.jsonl"
    path.write_text(json.dumps({"text": "an answer", **row}) + "\n")
    got = [r["label"] for r in normalize(spark.read.json(str(path)), "facts", "p").collect()]
    assert got == ([] if want is None else [want])


def one(spark, tmp_path, row, domain="facts"):
    path = tmp_path / "row.jsonl"
    path.write_text(json.dumps(row) + "\n")
    rows = normalize(spark.read.json(str(path)), domain, "p").collect()
    return rows[0] if rows else None


def test_answer_order_and_first_list_element(spark, tmp_path):
    row = one(spark, tmp_path, {"text": "t", "completion": None, "claim": "c", "input_strs": ["q1", "q2"], "label": 0})
    assert (row["assistant_text"], row["user_prompt"]) == ("c", "q1")
    row = one(spark, tmp_path, {"output_strs": ["x", "y"], "prompt": "p", "label": 1})
    assert row["assistant_text"] == "x"
    assert (row["domain"], row["source_path"]) == ("facts", "p")


def test_user_message_overrides_the_prompt_only_for_messages(spark, tmp_path):
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"},
                {"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}]
    row = one(spark, tmp_path, {"messages": messages, "prompt": "p", "label": 1})
    assert (row["assistant_text"], row["user_prompt"]) == ("a", "u")
    row = one(spark, tmp_path, {"messages": messages, "prompt": "p", "answer": "own", "label": 1})
    assert (row["assistant_text"], row["user_prompt"]) == ("own", "p")


def test_long_text_fallback(spark, tmp_path):
    row = one(spark, tmp_path, {"model": "m" * 40, "aa": "short", "body": "b" * 21, "z": "z" * 50, "label": 1})
    assert row["assistant_text"] == "b" * 21
    assert one(spark, tmp_path, {"body": "b" * 20, "label": 1}) is None


def test_default_prompts(spark, tmp_path):
    assert one(spark, tmp_path, {"text": "a", "label": 1})["user_prompt"] == DEFAULT_PROMPT
    assert one(spark, tmp_path, {"text": "a", "prompt": "\n a ", "label": 1})["user_prompt"] == DEFAULT_PROMPT
    assert one(spark, tmp_path, {"text": "a", "label": 1}, "ethical")["user_prompt"] == "Is this wrong?"
    assert one(spark, tmp_path, {"text": "a", "scenario": "s", "label": 1}, "ethical")["user_prompt"] == "s"


def test_claim_pairs(spark, tmp_path):
    path = tmp_path / "claims.jsonl"
    path.write_text(json.dumps({"Claim": "c", "Negated Claim": "n", "text": "other", "label": 1}) + "\n")
    rows = normalize(spark.read.json(str(path)), "facts", "p").orderBy("label").collect()
    assert [(r["assistant_text"], r["label"], r["user_prompt"]) for r in rows] == [
        ("c", 0, "Is this statement true?"), ("n", 1, "Is this statement true?")]


def test_nested_values_fill_missing_names_only(spark, tmp_path):
    row = one(spark, tmp_path, {"meta": {"text": "inner", "label": 1, "deep": {"prompt": "q"}}, "text": "outer"})
    assert (row["assistant_text"], row["label"], row["user_prompt"]) == ("outer", 1, "q")
    row = one(spark, tmp_path, {"blob": "{'text': 'spelled', 'is_deceptive': True, 'x': None, 'more': {'prompt': 'q'}}"})
    assert (row["assistant_text"], row["label"], row["user_prompt"]) == ("spelled", 1, "q")
    row = one(spark, tmp_path, {"blob": "{not a dict}", "text": "t", "label": 0})
    assert row["assistant_text"] == "t"


def test_csv_with_spelled_dict(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('blob,note\n"{\'answer\': \'yes, it is\', \'label\': \'lie\', \'ok\': True, \'no\': None}",n1\n')
    rows = normalize(tables.read_table(spark, str(path)), "facts", "p").collect()
    assert [(r["assistant_text"], r["label"]) for r in rows] == [("yes, it is", 1)]


def test_nothing_usable_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text(json.dumps({"text": "a", "label": "maybe"}) + "\n")
    with pytest.raises(ValueError, match="no row with both"):
        normalize_or_fail(spark.read.json(str(path)), "facts", str(path))


ROWS = [{"text": "a", "label": 0}, {"text": "b", "label": 1}]


@pytest.mark.parametrize("name,content", [
    ("list.json", ROWS), ("data.json", {"data": ROWS, "train": []}), ("records.json", {"info": 1, "records": ROWS}),
    ("columns.json", {"text": ["a", "b"], "label": [0, 1]}),
    ("single.json", {"source": "s", "text": ["a", "b"], "label": [0, 1]}),
])
def test_json_layouts(spark, tmp_path, name, content):
    path = tmp_path / name
    path.write_text(json.dumps(content, indent=1))
    rows = tables.read_table(spark, str(path)).select("text", "label").orderBy("text").collect()
    assert [(r["text"], r["label"]) for r in rows] == [("a", 0), ("b", 1)]


def test_json_keyed_layout_and_formats(spark, tmp_path):
    keyed = tmp_path / "keyed.json"
    keyed.write_text(json.dumps({"first": ROWS[:1], "second": ROWS[1:] + ROWS[1:]}))
    rows = tables.read_table(spark, str(keyed)).orderBy("text").collect()
    assert [(r["text"], r["_split_or_key"]) for r in rows] == [("a", "first"), ("b", "second"), ("b", "second")]
    equal = tmp_path / "equal.json"
    equal.write_text(json.dumps({"first": ROWS, "second": ROWS[::-1]}))
    table = tables.read_table(spark, str(equal))
    assert table.columns == ["first", "second"] and table.count() == 2
    assert {(r["assistant_text"], r["label"]) for r in normalize(table, "facts", "p").collect()} == {("a", 0), ("b", 1)}
    lines = tmp_path / "rows.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in ROWS))
    assert tables.read_table(spark, str(lines)).count() == 2
    spark.createDataFrame(ROWS).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps({"a": 1}))
    with pytest.raises(ValueError, match="keyed lists"):
        tables.read_table(spark, str(odd))
    with pytest.raises(ValueError, match="suffix"):
        tables.read_table(spark, str(tmp_path / "x.pkl"))


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


@pytest.fixture()
def root(tmp_path):
    both = [{"text": f"text {i}", "label": i % 2} for i in range(40)]
    write_lines(tmp_path / "facts_one_class.jsonl", [{"text": "t", "label": 1}])
    write_lines(tmp_path / "deep" / "empirical.jsonl", both)
    write_lines(tmp_path / "facts_result.jsonl", both)
    write_lines(tmp_path / "Logical.JSONL", both[:10])
    write_lines(tmp_path / "roleplaying.jsonl", [{"text": f"r{i}", "label": 1} for i in range(5)])
    write_lines(tmp_path / "alpaca.jsonl", [{"text": f"a{i}", "label": i % 2} for i in range(7)])
    write_lines(tmp_path / "logical_metrics.csv", [])
    write_lines(tmp_path / "fiction.jsonl", [{"text": "x", "label": "maybe"}])
    (tmp_path / "notes.txt").write_text("facts")
    return tmp_path


def test_discovery_order_and_skips(spark, root):
    found = discovery.find_files(spark, str(root), "empirical")
    assert [f.removeprefix(str(root) + "/") for f in found] == ["deep/empirical.jsonl", "facts_one_class.jsonl"] or \
        [f.removeprefix(str(root) + "/") for f in found] == sorted(
            ["deep/empirical.jsonl", "facts_one_class.jsonl"], key=lambda p: (len(p), p))
    assert [f.rsplit("/", 1)[-1] for f in discovery.find_files(spark, str(root), "logical")] == ["Logical.JSONL"]


def test_load_domains(spark, root):
    rows, verdicts = loading.load_domains(
        spark, str(root), ["empirical", "logical", "roleplaying", "fictional", "ethical"])
    counts = {(r["domain"], r["label"]): r["count"] for r in rows.groupBy("domain", "label").count().collect()}
    assert counts == {("empirical", 0): 20, ("empirical", 1): 20, ("logical", 0): 5, ("logical", 1): 5,
                      ("roleplaying", 0): 7, ("roleplaying", 1): 5}
    seen = {(r["domain"], r["usable"]): r["reason"] for r in verdicts.collect()}
    assert {d for d, usable in seen if not usable} - {d for d, usable in seen if usable} == {"fictional", "ethical"}
    assert seen["ethical", False] == "no file name matches"
    flipped = rows.filter("domain = 'empirical' and assistant_text = 'text 0'").first()
    assert flipped["label"] == 1
    none, _ = loading.load_domains(spark, str(root), ["ethical"])
    assert none.columns == ["domain", "user_prompt", "assistant_text", "label", "source_path"] and none.isEmpty()
    with pytest.raises(loading.NoUsableFile, match="fictional"):
        loading.load_domain(spark, str(root), "fictional")
    with pytest.raises(loading.NoUsableFile, match="no file name"):
        loading.load_domain(spark, str(root), "ethical")


def test_cap_keeps_both_labels(spark, root):
    rows = loading.load_domain(spark, str(root), "empirical", cap=10)
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {0: 5, 1: 5}


def test_example_ids_are_dense_and_stable(spark):
    rows = spark.range(1000).repartition(5).select(F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 2).alias("label"))
    out = loading.with_example_ids(rows)
    first = {r["example_id"]: r["text"] for r in out.collect()}
    assert sorted(first) == list(range(1000))
    assert {r["example_id"]: r["text"] for r in out.repartition(3).collect()} == first


def test_benchmarks(spark, tmp_path):
    write_lines(tmp_path / "q.jsonl", [
        {"question": "q1", "best_answer": "r", "incorrect_answers": ["w1", "w2"]},
        {"question": "q2", "best_answer": "s", "incorrect_answers": []}])
    write_lines(tmp_path / "c.jsonl", [
        {"claim": f"c{i}", "label": ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"][i % 3]} for i in range(12)])
    rows, verdicts = loading.load_benchmarks(spark, str(tmp_path / "q.jsonl"), str(tmp_path / "c.jsonl"), per_class=3)
    counts = {(r["domain"], r["label"]): r["count"] for r in rows.groupBy("domain", "label").count().collect()}
    assert counts == {("truthfulqa", 0): 2, ("truthfulqa", 1): 1, ("fever", 0): 3, ("fever", 1): 3}
    short, verdicts = loading.load_benchmarks(spark, None, str(tmp_path / "c.jsonl"), per_class=5)
    assert short.isEmpty() and [r["usable"] for r in verdicts.collect()] == [False]


def test_chat_pairs(spark):
    turns = spark.createDataFrame([
        (1, 2, "user", "later"), (1, 1, "user", "u"), (1, 3, "assistant", "a"), (1, 0, "system", "s"),
        (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    rows = chat_pairs(turns).collect()
    assert [(r["conv_id"], r["user_prompt"], r["assistant_text"]) for r in rows] == [(1, "u", "a")]


def test_missing_fallbacks_count_by_their_column(spark):
    rows = [("an answer", "maybe", None, None)]
    flag = spark.createDataFrame(rows, "text string, label string, is_true boolean, other int").drop("other")
    number = spark.createDataFrame(rows, "text string, label string, other boolean, is_true int").drop("other")
    assert [[r["label"] for r in normalize(df, "facts", "p").collect()] for df in (flag, number)] == [[1], [0]]


def flattened(row):
    """The reference rule on Python values: outer names first, then those of nested dictionaries."""
    out = dict(row)
    for _ in range(3):
        for value in list(out.values()):
            if isinstance(value, dict):
                for name in sorted(value):
                    out.setdefault(name, value[name])
    return out


SHAPELESS = [
    ({"text": "an answer", "label": 1}, "an answer", 1), ({"text": "an answer", "label": "true", "honest": False}, "an answer", 1),
    ({"text": ["one", "two"], "label": [0, "x"]}, "one", 0), ({"text": "an answer", "label": [], "target": "lie"}, "an answer", 1),
    ({"text": "an answer", "label": None, "target": "truth"}, "an answer", 0), ({"a": {"b": {"text": "deep", "label": 1.9}}}, "deep", 1),
    ({"a": {"b": {"c": {"text": "three down", "label": True}}}}, "three down", 1), ({"a": {"b": {"c": {"d": {"text": "too deep", "label": 1}}}}}, None, None),
    ({"text": "an answer", "label": {"k": 1}, "is_true": True}, "an answer", 0), ({"text": "an answer", "label": 5, "is_true": True}, None, None),
    ({"label": 0, "messages": [{"role": "user", "content": "why"}, {"role": "assistant", "content": "so"}]}, "so", 0),
    ({"text": 7, "label": 1}, "7", 1), ({"text": "outer", "a": {"text": "inner", "label": 0}}, "outer", 0), ([1, 2], None, None), ("words", None, None),
]


def test_rows_without_a_fixed_shape(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps(row) + "\n" for row, _, _ in SHAPELESS))
    raw = tables.read_shapeless(spark, str(path)).withColumn("n", F.monotonically_increasing_id()).coalesce(1)
    got = {r["n"]: (r["assistant_text"], r["label"]) for r in normalize(raw, "facts", "p", literal_columns=(), keep=("n",)).collect()}
    assert got == {i: (text, label) for i, (_, text, label) in enumerate(SHAPELESS) if text is not None}
    for row, text, _ in SHAPELESS:
        if isinstance(row, dict) and isinstance(text, str) and "messages" not in row and not isinstance(flattened(row)["text"], (list, int)):
            assert flattened(row)["text"] == text


def test_maps_are_looked_into(spark):
    rows = [(1, {"text": "from a map", "label": "lie"}, None, {"x": {"text": "inner"}}), (2, {"note": "n"}, "truth", {"x": {"text": "in a map of maps"}}),
            (3, None, "truth", None), (4, {}, None, {"x": {"label": "1", "text": "both"}}), (5, {"text": None, "label": "lie"}, None, None)]
    raw = spark.createDataFrame(rows, "n int, record map<string,string>, label string, more map<string,map<string,string>>").select(
        "n", F.struct("record", "more").alias("held"), "label")
    got = {r["n"]: (r["assistant_text"], r["label"]) for r in normalize(raw, "facts", "p", literal_columns=(), keep=("n",)).collect()}
    assert got == {2: ("in a map of maps", 0)}  # the column label is outer, also where it is empty
    got = {r["n"]: (r["assistant_text"], r["label"]) for r in normalize(raw.drop("label"), "facts", "p", literal_columns=(), keep=("n",)).collect()}
    assert got == {1: ("from a map", 1), 4: ("both", 1)}
