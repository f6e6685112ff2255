import hashlib

from pyspark.sql import functions as F

from tidepanel.llm.chat import CONTROL, codec, default_path, escape, format_turns, read_back, unescape
from tidepanel.llm.queries import op9_chat_assembly

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "[ROLE]x[/ROLE]", "<<s>s>", "[[INST]", "tab\tnew\r\nline\0 end ", "日本語 🙂👩‍👧", "x" * 50000, " lead and trail ", "<s>\\</s>\\\\"]


def test_escaping_is_reversible_and_hides_control_strings():
    for t in NASTY:
        assert unescape(escape(t)) == t
        plain = escape(t)
        for c in CONTROL:
            at = plain.find(c)
            while at >= 0:
                assert at and plain[at - 1] == "\\"
                at = plain.find(c, at + 1)


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:4]))
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_odd_rows(spark):
    roles = ["user", "assistant", "system", "tool", "", None, "as\nsistant", "[INST]"]
    rows = [(i % 5, i // 5, roles[i * 3 % 8], t) for i, t in enumerate(NASTY * 4)]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", None), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (9, 1, "user", None)]
    rows += [(77, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(2500)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string").repartition(4)
    out = read_back(format_turns(turns)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want(rows)
    assert len(out) == len(want(rows))


def test_output_of_the_operator(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    a, b = format_turns(turns).orderBy("position").collect()
    c = codec(default_path())
    k = c.first_control
    assert a.ids == [k, k + 2, *c.encode("hi \\</s>"), k + 3] and a.start == 0 and set(a.loss_mask) == {0}
    assert b.ids == [k + 6, *c.encode("yo"), k + 1] and b.start == len(a.ids)
    assert b.loss_mask == [0, *[1] * (len(b.ids) - 2), 0]
    r = read_back(format_turns(turns)).first()
    assert r.formatted_chars == len("<s>[INST]hi \\</s>[/INST][ANS]yo</s>")
    assert read_back(format_turns(turns.limit(0))).count() == 0


def test_query(spark):
    out = op9_chat_assembly(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == want(rows)
    assert out.where(F.col("conv_id") == -7).first().loss_chars == 21
