import hashlib

from spindrift.llm import chat as C

ROW = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "[INST] user [/INST] x</s>", "&lt;/s&gt; & &amp;lt; [INST*] ", " [/INST] ", "</s>", "", None, "plain", "</</s>", "a\n[/INST]\n</s", "[INST* [INST]", "&lb;"]


def test_round_trip(spark):
    rows = [(c, t, r, NASTY[(c * 5 + t * 3) % len(NASTY)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", None, "odd [/INST] role", "assistant"])]
    got = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, ROW)).collect()}
    for c in range(12):
        own = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        g = got[c]
        assert g.identical and [(t.role, t.text) for t in g.turns] == [(r, x) for _, r, x in own]
        assert g.loss == "".join(x for _, r, x in own if r == "assistant")
        parts = [g.formatted[m.start : m.end] for m in g.mask]
        assert len(parts) == sum(r == "assistant" for _, r, _ in own)
        assert g.formatted.count("</s>") == len(own)


def test_masks_hold_the_texts(spark):
    rows = [(1, 0, "user", "hi é"), (1, 1, "assistant", "first 🙂"), (1, 2, "user", "</s>"), (1, 3, "assistant", "second")]
    g = C.format_conversations(spark.createDataFrame(rows, ROW)).collect()[0]
    assert [g.formatted[m.start : m.end] for m in g.mask] == ["first 🙂", "second"] and g.n_escaped == 1


def test_ties_nulls_repeats_empty(spark):
    rows = [(None, None, None, None), (None, 0, "user", "x"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "assistant", "z"), (2, 1, "user", "a")]
    got = {r.conv_id: r for r in C.digests(C.format_conversations(spark.createDataFrame(rows, ROW).selectExpr("*", "'c' AS formatted", "'d' AS turns"))).collect()}
    assert got[2].n_turns == 4 and got[None].n_turns == 2 and all(r.identical for r in got.values())
    told = "assistant\nz\nuser\na\nuser\na\nuser\nb\n"
    assert got[2].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert C.format_conversations(spark.createDataFrame([], ROW)).count() == 0


def test_loss_is_read_under_the_mask(spark, monkeypatch):
    """A mask that is off shows in the loss and in identical."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "first </s>"), (1, 2, "assistant", "second")]
    df = spark.createDataFrame(rows, ROW)
    good = C.format_conversations(df).collect()[0]
    assert good.loss == "first </s>second" and good.identical
    whole = C.F.instr
    monkeypatch.setattr(C.F, "instr", lambda a, b: whole(a, b) + 1 if isinstance(a, str) else whole(a, b))
    bad = C.format_conversations(df).collect()[0]
    assert bad.loss != good.loss and not bad.identical
