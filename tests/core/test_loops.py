"""Loop semantics restated in plain Python against the operators, on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import actions, chat, clustering, episodes, evaluation, kg2kv, matching, outputs, retrieval, sampling


def test_matching_equals_the_scan(spark):
    rng = random.Random(1)
    for n, ends in ((300, 40), (300, 400), (50, 2)):
        edges = [(i, f"n{rng.randrange(ends)}", f"n{rng.randrange(ends)}") for i in range(n)]
        used, want = set(), []
        for i, a, b in edges:
            if a not in used and b not in used:
                used |= {a, b}
                want.append(i)
        for scan_rows in (10, 1000):
            got = matching.first_come_matching(spark.createDataFrame(edges, "rid long, head string, tail string").repartition(3), scan_rows=scan_rows)
            assert sorted(r.rid for r in got.collect()) == want
    chain = spark.range(5000).selectExpr("id rid", "cast(id as string) head", "cast(id + 1 as string) tail")
    assert [r.rid for r in matching.first_come_matching(chain, scan_rows=2000).orderBy("rid").collect()] == list(range(0, 5000, 2))
    assert matching.first_come_matching(chain.limit(0)).count() == 0


def test_batches_and_split(spark):
    rows = spark.range(1234).select((F.col("id") * 7 % 1234).alias("rid"))
    got = {r.rid: r.batch_id for r in kg2kv.batch_ids(rows, "rid", 100).collect()}
    assert got == {i: i // 100 for i in range(1234)}


@pytest.mark.parametrize("target", [0, 1, 7, 50, 99, 100, 1000])
def test_quotas_sum_to_the_target(spark, target):
    caps = {"a": 1, "b": 3, "c": 3, "d": 40, "e": 53}
    rows = sampling.largest_remainder(spark.createDataFrame(list(caps.items()), "bucket string, capacity long"), target).collect()
    total = sum(caps.values())
    if target >= total:
        want = caps
    else:
        want = {k: target * c // total for k, c in caps.items()}
        for k in sorted(caps, key=lambda k: (target * caps[k] % total, k), reverse=True)[: target - sum(want.values())]:
            want[k] += 1
    assert {r.bucket: r.quota for r in rows} == want and sum(want.values()) == min(target, total)


def test_round_robin_takes_every_episode_first(spark):
    rows = [("x", f"e{k % 7}", f"i{k}") for k in range(60)] + [("y", "e0", f"j{k}") for k in range(5)]
    got = sampling.stratified(spark.createDataFrame(rows, "bucket string, episode string, id string"), 20, rare=5).collect()
    assert len(got) == 20 and sum(r.bucket == "y" for r in got) == 5
    per = {}
    for r in got:
        if r.bucket == "x":
            per[r.episode] = per.get(r.episode, 0) + 1
    assert set(per.values()) <= {2, 3} and len(per) == 7


def test_pruning_with_large_k_is_flat(spark):
    rng = random.Random(2)
    leaves = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)], "id long, key array<double>")
    edges = leaves.select("id", (F.col("id") % 9).alias("inter_id"), (F.col("id") % 9 % 3).alias("root_id"))
    queries = leaves.filter("id < 4").select(F.col("id").alias("query_id"), F.col("key").alias("query"))
    take = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    assert take(retrieval.hierarchical_topk(queries, leaves, edges, 99, 99, 5)) == take(retrieval.flat_topk(queries, leaves, 5))
    assert retrieval.flat_topk(queries, leaves, 1000).count() == 4 * 80


def test_ancestors_of_an_unknown_leaf_fail(spark):
    edges = spark.createDataFrame([(1, 2, 3)], "id long, inter_id long, root_id long")
    with pytest.raises(Exception, match="leaf without a cluster"):
        retrieval.ancestors(spark.createDataFrame([(1,), (9,)], "id long"), edges).collect()


def test_hierarchy_levels(spark):
    rng = random.Random(3)
    leaves = spark.createDataFrame([(i, [rng.gauss(4 * (i % 5), 1) for _ in range(6)]) for i in range(120)], "id long, key array<double>")
    sizes = clustering.level_sizes(120)
    assert sizes == [25, 5]
    first, second = clustering.fit_hierarchy(leaves, dims=3, restarts=1, iterations=5)
    assert first.count() == 120 and second.count() == sizes[0] and second.select("cluster").distinct().count() <= sizes[1]


def test_phrases(spark):
    cases = {
        "open the app": ("opening the app", "having opened the app"),
        "To tap it.": ("tapping it", "having tapped it"),
        "tie a knot": ("tying a knot", "having tied a knot"),
        "agree now": ("agreeing now", "having agreed now"),
        "fix it": ("fixing it", "having fixed it"),
        "Saving files": ("saving files", "having saved files"),
        "running off": ("running off", "having run off"),
        "long-press item": ("long pressing item", "having long pressed item"),
        "42 items": ("42 items", "having completed 42 items"),
        "": ("the current task", "starting from the initial state"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", t.goal_phrase(F.col("s")).alias("g"), t.completed_goal_phrase(F.col("s")).alias("d")).collect()
    got = {r.s: (r.g, r.d) for r in rows}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in cases.items()}
    assert all(got[k][0] == v[0] for k, v in cases.items() if k)


#: Actions and the rule that each breaks, if the screen shows elements 0 and 2.
ACTIONS = [
    (dict(action_type="click", idx=2), None),
    (dict(action_type="click", x=1, y=2), None),
    (dict(action_type="long_press", idx=0), None),
    (dict(action_type="input_text", idx=0, text=""), None),
    (dict(action_type="keyboard_enter"), None),
    (dict(action_type="navigate_home"), None),
    (dict(action_type="scroll", direction="up"), None),
    (dict(action_type="scroll", direction="down", idx=2), None),
    (dict(action_type="open_app", app_name="Clock"), None),
    (dict(action_type="answer", text="5"), None),
    (dict(action_type="status", goal_status="complete"), None),
    (dict(action_type="wait"), None),
    (dict(action_type=None), "missing_action_type"),
    (dict(action_type="swipe"), "unsupported_action_type"),
    (dict(action_type="click", idx=1), "index_out_of_range"),
    (dict(action_type="click", idx=2, x=1), "conflicting_action_fields"),
    (dict(action_type="click", x=1), "missing_action_field"),
    (dict(action_type="scroll", direction="in"), "invalid_action_enum"),
    (dict(action_type="open_app", app_name=" "), "invalid_action_field"),
    (dict(action_type="wait", text="x"), "unsupported_action_field"),
    (dict(action_type="click", idx=-1), "invalid_action_field"),
]
FIELDS = ("action_type", "idx", "x", "y", "text", "direction", "app_name", "goal_status")
SCHEMA = "k int, action_type string, idx long, x long, y long, text string, direction string, app_name string, goal_status string"


def test_action_rules(spark):
    rows = spark.createDataFrame([(k, *(a.get(f) for f in FIELDS)) for k, (a, _) in enumerate(ACTIONS)], SCHEMA)
    visible = F.array(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))
    got = {r.k: r.code for r in rows.select("k", actions.error_code(visible).alias("code")).collect()}
    assert got == {k: code for k, (_, code) in enumerate(ACTIONS)}
    points = {r.k: r.code for r in rows.select("k", actions.error_code(visible, index_only=True).alias("code")).collect()}
    assert points[1] == "missing_index_action"


def test_row_identity(spark):
    steps = spark.createDataFrame([("e1", 0, "open x", "open_app", None, None, None, "X", None), ("e1", 1, None, "input_text", 4, "hi", None, None, None), ("e2", 0, "tap", "click", 9, None, None, None, None)], "episode_id string, step_index long, instruction string, action_type string, idx long, text string, direction string, app_name string, goal_status string")
    steps = steps.withColumns({"goal": F.lit("Find it."), "ui": F.lit(None).cast("string")})
    rows = steps.withColumn("conversion_error", F.lit(None).cast("string")).withColumn("invalid", F.when(F.col("idx") == 9, "index_out_of_range"))
    built = episodes.qkv_rows(rows)
    c = episodes.qkv_counts(built).collect()[0]
    assert c.qkv_rows == c.prompt_rows + c.keyboard_enter_rows + c.terminal_rows == 6 and c.invalid_actions == 1
    names = {r.name for r in built.collect()}
    assert "aw_e2_0_click_infeasible" in names and "aw_e1_1_keyboard_enter_keyboard_enter_after_input_text" in names
    assert episodes.qkv_rows(rows, skip_invalid=True).count() == 5
    found = {r.name: r for r in built.collect()}
    assert all(r.A == r.description and r.description.startswith(f"Reason: {r.reason}\nAction: ") and r.extended_Q == "" for r in found.values())
    # Without an instruction the goal is the task, and the last instruction of the history is what was done.
    assert found["aw_e1_1_input_text"].key_string == "For the AndroidWorld goal of finding it, after having opened x, the current screen shows the visible UI elements, and the next action should be"
    assert "History: Step 1: Action selected: {\"action_type\": \"open_app\", \"app_name\": \"X\"}. Instruction: open x.\nThe visible" in found["aw_e1_1_input_text"].Q
    assert 'Step 2: Action selected: {"action_type":"input_text","index":4,"text":"hi"}.' in found["aw_e1_1_terminal_complete_status_complete"].Q
    assert "so the task should be marked infeasible." in found["aw_e2_0_click_infeasible"].reason
    key = found["aw_e1_0_open_app"].key_string
    assert key == "For the AndroidWorld goal of opening x, after no previous actions, the current screen shows the visible UI elements, and the next action should be"


def test_outputs():
    assert outputs.balanced_object('a {"x": "}"} b') == (2, 12) and outputs.balanced_object("{") is None
    assert outputs.normalized_output("Reason: why  not\nAction: {'action_type': 'wait'}") == ("why not", '{"action_type":"wait"}', None)
    for text, code in (("", "empty_action_output"), ("x", "missing_action"), ("Action: 5", "missing_action_object"), ("Action: x {}", "invalid_action_json"), ("Action: {1: 2}", "invalid_action_json"), ("Action: {}", "missing_action_type"), ("Reason: a Reason: b Action: {}", "multiple_reasons"), ("Reason: {a} Action: {}", "invalid_reason"), ("Action: {} {", "multiple_actions"), ('Action: {"a": "b', "invalid_action_json")):
        assert outputs.normalized_output(text)[2] == code, text


def test_checked_actions():
    """The accepted and the refused cases of a screen that shows 0 and 2."""
    shown = frozenset({0, 2})
    good = [
        {"action_type": "status", "goal_status": "complete"}, {"action_type": "answer", "text": "10 AM"}, {"action_type": "click", "index": "2"}, {"action_type": "click", "x": 100, "y": 200},
        {"action_type": "long_press", "index": 2}, {"action_type": "input_text", "index": 2, "text": "Alice"}, {"action_type": "keyboard_enter"}, {"action_type": "navigate_home"},
        {"action_type": "navigate_back"}, {"action_type": "scroll", "direction": "down"}, {"action_type": "scroll", "direction": "up", "index": 2}, {"action_type": "open_app", "app_name": "Contacts"}, {"action_type": "wait"},
    ]
    for action in good:
        found, error = outputs.checked_action(action, shown)
        assert error is None and found == {k: int(v) if k == "index" else v for k, v in action.items()}
    for action, code in (
        ({"action_type": "send", "index": 0}, "unsupported_action_type"), ({"action_type": "click"}, "missing_action_field"), ({"action_type": "click", "index": 1}, "index_out_of_range"),
        ({"action_type": "click", "index": 0, "x": 1, "y": 2}, "conflicting_action_fields"), ({"action_type": "input_text", "text": "Alice"}, "missing_action_field"),
        ({"action_type": "scroll", "direction": "diagonal"}, "invalid_action_enum"), ({"action_type": "status", "goal_status": "success"}, "invalid_action_enum"), ({"action_type": "wait", "index": 0}, "unsupported_action_field"),
        ({"action_type": "click", "index": True}, "invalid_action_field"), ({"action_type": "click", "index": -1}, "invalid_action_field"), ({"action_type": "answer", "text": " "}, "invalid_action_field"),
    ):
        assert outputs.checked_action(action, shown) == (None, code), action


ACTION_PROMPT = "Here is a list of descriptions for some UI elements on the current screen:\nUI element 0: a\nUI element 2: b\nNow output an action from the above list, action_type. Your answer should look like:\nReason: ..."
SUMMARY_PROMPT = "This is the action you picked: x\nBased on the reason: y\nSummary of this step:"


def test_outputs_follow_their_request(spark):
    rows = [
        (ACTION_PROMPT, "```python\nThe answer is Action: {'action_type': 'click', 'index': '2'}\n``` extra explanation"),
        (ACTION_PROMPT, 'Action: {"action_type":"click","index":1}'),
        (SUMMARY_PROMPT, "Summary of this step: Opened Contacts.\nIt worked."),
        (SUMMARY_PROMPT, 'Action: {"action_type":"wait"}'),
        ("hello", "as it  is"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, prompt string, raw string")
    got = [tuple(r.processed) for r in outputs.with_processed(frame, "prompt", "raw").orderBy("i").collect()]
    assert got == [
        ("action_selection", 'Reason: Model selected the next action.\nAction: {"action_type":"click","index":2}', '{"action_type":"click","index":2}', None),
        ("action_selection", None, None, "index_out_of_range"),
        ("summarization", "Opened Contacts. It worked.", None, None),
        ("summarization", None, None, "invalid_summary_output"),
        ("other", "as it  is", None, None),
    ]
    steps = [("Reason: go\nAction: {\"a\": 1} Action: {\"b\": 2}", 'Thought: go\nAction: {"a": 1}'), ('Action: {"a":1}', 'Thought:\nAction: {"a": 1}'), ("no action", "no action"), (None, None)]
    assert [outputs.single_step(x) for x, _ in steps] == [y for _, y in steps]


def test_requests_keep_their_images(spark):
    part = lambda kind, text=None, url=None: (kind, text, url)
    rows = [(1, [("user", [part("text", ACTION_PROMPT), part("image_url", None, "data:x")])], 1024), (2, [("user", [part("text", ACTION_PROMPT)])], None), (3, [("user", [part("text", "hi")])], 500)]
    frame = spark.createDataFrame(rows, "i int, messages array<struct<role:string,parts:array<struct<type:string,text:string,url:string>>>>, max_tokens int")
    got = {r.i: r for r in chat.rewritten(frame, lambda text: F.lit("What is the next AndroidWorld action?")).collect()}
    assert [tuple(p) for p in got[1].messages[0].parts] == [("text", "What is the next AndroidWorld action?", None), ("image_url", None, "data:x")]
    assert (got[1].max_tokens, got[2].max_tokens, got[3].max_tokens) == (128, 128, 500) and got[3].messages[0].parts[0].text == "hi"


def test_envelopes(spark):
    one = spark.range(1).select(chat.envelope(F.lit("c"), "m", F.lit(5), F.lit(10), F.lit(5), kv_injected=F.lit(True)).alias("e"), chat.error_envelope(F.lit("bad action"), F.lit("unsupported_action_type"), F.lit("completion")).alias("x")).collect()[0]
    assert one.e.object == "chat.completion" and one.e.choices[0].message.role == "assistant" and one.e.choices[0].finish_reason == "stop" and one.e.kv_injected is True and one.e.usage.total_tokens == 15
    assert one.x.asDict(True) == {"error": {"message": "bad action", "type": "invalid_request_error", "param": "completion", "code": "unsupported_action_type"}}
    texts = spark.createDataFrame([("<|eot_id|>hi<|end|>", "Q: a\nA: b", " 7 ")], "s string, qa string, n string").select(chat.stripped(F.col("s")).alias("s"), chat.wrapped(F.col("s")).alias("w"), evaluation.qa_lines(F.col("qa")).alias("q"), actions.parsed_index(F.col("n")).alias("n"), evaluation.visible_indices(F.lit("UI element 3: x UI element 1: y")).alias("v"), t.last_instruction(F.lit("Step 1: x. Instruction: a.\nStep 2: y. Instruction: b  c.")).alias("l")).collect()[0]
    assert texts.s == "hi" and texts.w.endswith("assistant<|end_header_id|>") and tuple(texts.q) == ("a", "b") and texts.n == 7 and texts.v == [1, 3] and texts.l == "b c"


def test_what_a_history_tells(spark):
    started = "You just started, no action has been performed yet."
    cases = [
        ("tap x", None, "having tapped x"), (None, None, "no previous actions"), (None, started, "no previous actions"), (None, 'Step 1: Action selected: {"action_type": "wait"}.', "previous recorded actions"),
        (None, 'Step 1: Action selected: {"action_type": "wait"}. Instruction: open y.\nStep 2: z', "having opened y"), (None, "Step 1: looked around.", "looked around"),
    ]
    frame = spark.createDataFrame([(i, p, h) for i, (p, h, _) in enumerate(cases)], "i int, p string, h string")
    assert [r.o for r in frame.select("i", episodes.history_phrase(F.col("p"), F.col("h")).alias("o")).orderBy("i").collect()] == [w for *_, w in cases]


def test_draws_are_without_replacement(spark):
    from quern.operators import augment

    steps = augment.step_schedule(spark, 30, 2, 3, extended=True)
    rows = augment.draws(steps, 8, 97).collect()
    kinds = {r.step: r.kind for r in rows}
    assert [kinds[s] for s in (0, 1, 2, 26, 27, 29)] == ["multi", "extended", "plain", "plain", "outlier", "outlier"]
    for step in range(30):
        own = [r.position for r in rows if r.step == step]
        assert len(own) == len(set(own)) == (24 if kinds[step] == "multi" else 8) and all(0 <= p < 97 for p in own)


def test_summaries_and_prompts(spark):
    rows = spark.createDataFrame([("```text\nSummary of this step: it  went well```",), ("Action: x",), ("  ",)], "s string")
    got = [(r.o.summary, r.o.error) for r in rows.select(outputs.normalized_summary(F.col("s")).alias("o")).collect()]
    assert got == [("it went well", None), (None, "invalid_summary_output"), (None, "empty_summary_output")]
    kept = spark.createDataFrame([(list(range(10)), 8), (list(range(10)), 2), ([1, 2], 1)], "t array<int>, a int").select(chat.truncated(F.col("t"), F.col("a"), 5).alias("o")).collect()
    assert [r.o for r in kept] == [[5, 6, 7, 8, 9], [2, 3, 4, 5, 6], [1, 2]]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_longest_common_subsequence(spark):
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 8))), " ".join(rng.choices("abc", k=rng.randint(0, 8)))) for i in range(40)]
    got = {r.id: r.lcs for r in evaluation.rouge_l(spark.createDataFrame(pairs, "id long, predicted string, truth string")).collect()}
    assert got == {i: lcs(a.split(), b.split()) for i, a, b in pairs}


def test_transcripts(spark):
    text = "Question: a?\nPREDICTION: x is y\nTRUE: z\n" + "-" * 20 + "\nQuestion: b?\nPREDICTION: p\nTRUE: q\n" + "-" * 20 + "\n"
    rows = evaluation.transcripts(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(r) for r in rows] == [("a?", "x is y", "z"), ("b?", "p", "q")]


def test_listing_round_trip(spark):
    from quern.operators import screens
    from quern.plans import registry
    from quern.plans.screen_queries import _listed

    folder = "/root/testdata/sf0.001"
    got = {(r.screen, r.idx): r for r in registry.queries()["listing_round_trip"](spark, folder).collect()}
    want = {(r.screen, r.idx): r for r in _listed(spark, folder).collect()}
    assert len(got) > 1000
    assert screens.parsed_line("UI element 7: UIElement(text='a, b', bbox=Box(x=1, y=2), is_clickable, disabled)")["is_enabled"] is False
    assert screens.parsed_line("UI element 7: other") is None
    for k, r in got.items():
        text = " ".join(want[k].text.split()) if want[k].text else None
        assert r.text == text and bool(r.is_clickable) == want[k].is_clickable and (r.is_enabled is not False) == want[k].is_enabled


def test_informative_rules(spark):
    from quern.operators import screens

    base = dict.fromkeys(("text", "content_description", "hint_text", "class_name", "resource_name"))
    flags = dict.fromkeys(screens.FLAGS, False) | {"is_enabled": True}
    long = "word " * 20
    cases = [
        ({"text": "Save"}, True),
        ({"text": "8b1a9953c4611296a827"}, False),
        ({"text": long, "class_name": "a.TextView"}, False),
        ({"text": long, "class_name": "a.Button"}, True),
        ({"text": long, "class_name": "a.TextView", "is_clickable": True}, True),
        ({"text": long, "class_name": "a.TextView", "content_description": "d"}, True),
        ({"class_name": "a.View", "is_clickable": True}, False),
        ({"class_name": "a.Button", "is_clickable": True}, True),
        ({"is_enabled": False}, True),
        ({"resource_name": "x:id/wifi_toggle"}, True),
        ({"resource_name": "x:id/list_item"}, False),
        ({"is_scrollable": True}, True),
        ({}, False),
    ]
    schema = ", ".join([f"{c} string" for c in base] + [f"{c} boolean" for c in flags])
    rows = [tuple({**base, **flags, **c}.values()) for c, _ in cases]
    got = [r.i for r in spark.createDataFrame(rows, schema).coalesce(1).select(screens.informative().alias("i")).collect()]
    assert got == [want for _, want in cases]


def test_embeddings_have_unit_length(spark):
    from quern.functions import vectors

    rows = [r.e for r in spark.createDataFrame([("a b c",), ("A b, c",), (None,)], "s string").coalesce(1).select(vectors.hashed_embedding(F.col("s")).alias("e")).collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-9 and rows[0] == rows[1] and not any(rows[2])


def test_system_packages(spark):
    from quern.operators.geometry import package_kind

    names = ["android", "com.android.packageinstaller", "com.android.permissioncontroller", "com.android.systemui", "com.google.android.permissioncontroller", "my.inputmethod", "app", "", None]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in frame.select(package_kind(F.col("p"))).collect()] == ["system"] * 5 + ["keyboard", None, None, None]


def test_value_types(spark):
    from quern.operators.stats import value_profile

    objects = ['{"a": 1, "b": 1.5, "c": true, "d": null, "e": [1], "f": {"x": 1}, "g": "s", "h": 1.0}', "[1]", "{", "", None, "{}", '{"a": "x"}']
    frame = spark.createDataFrame([(o,) for o in objects], "j string")
    found = {(r.field, r.type): r.n for r in value_profile(frame, F.lit(""), F.col("j")).filter("key = 'missing'").collect()}
    kinds = dict(a="int", b="float", c="bool", d="null", e="list", f="dict", g="str", h="float")
    assert found == {**{(k, v): 1 for k, v in kinds.items()}, ("a", "str"): 1}


def test_counter_texts(spark):
    from quern.operators import stats

    frame = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "key string, n long")
    assert stats.counter_text("t", frame) == "t:\n  c: 9\n  a: 2\n  b: 2"
    assert stats.counter_text("t", frame.limit(0)) == "t:\n  none: 0"
    with pytest.raises(ValueError):
        stats.counter_text("t", frame, most=2)
    steps = spark.createDataFrame([("e1",), ("e1",), ("e2",)], "ep string")
    assert stats.lengths_text("t", stats.length_stats(steps, "ep")) == "t: avg=1.5, min=1 (e2), max=2 (e1)"
