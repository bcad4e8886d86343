import hashlib

from tidemark.llm.chat import rotate


def plain(messages):
    """(conv, perspective) -> the rendered text and what is trained on."""
    out = {}
    for conv in {m[0] for m in messages}:
        own = sorted((m for m in messages if m[0] == conv), key=lambda m: (m[1] is not None, m[1] or 0, m[2] is not None, m[2] or "", hashlib.sha256((m[3] or "").encode()).hexdigest()))
        for who in {m[2] for m in own} - {"system", None}:
            text, trained = "", []
            for _, _, speaker, said in own:
                role = "system" if speaker == "system" else "assistant" if speaker == who else "user"
                text += f"<|im_start|>{role}" + (f" name={speaker}" if role == "user" and speaker else "") + "\n"
                at = len(text)
                text += (said or "") + "<|im_end|>"
                if role == "assistant":
                    trained.append((at, len(text)))
                text += "\n"
            out[conv, who] = (text, trained)
    return out


def rendered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.start):
        text, trained = out.setdefault((r.conv_id, r.perspective), ("", []))
        assert r.start == len(text) and r.end == r.start + len(r.segment)
        out[r.conv_id, r.perspective] = (text + r.segment, trained + ([(r.train_start, r.train_end)] if r.train_start is not None else []))
    return out


MESSAGES = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hé 😀?"), (1, 2, "bob", "Yes."), (1, 3, "cy", None), (1, 4, "ann", ""),
    (2, 0, "system", "alone"), (3, None, "ann", "no turn"), (3, 5, None, "no name"), (3, 5, None, "no name"), (3, 5, "ann", "tie"), (None, 1, "dan", "no conversation"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*m, "x") for m in rows], "conv_id long, turn long, role string, text string, block string").repartition(3)


def test_every_perspective_is_the_whole_dialogue(spark):
    assert rendered(rotate(frame(spark, MESSAGES)).collect()) == plain(MESSAGES)


def test_long_conversations_are_summed_in_blocks(spark):
    many = [(9, t, ("ann", "bob", "cy")[t % 3], "w" * (t % 11)) for t in range(1000)]
    assert rendered(rotate(frame(spark, many)).collect()) == plain(many)


def test_repeated_turns_of_no_conversation_are_summed_in_blocks(spark):
    """A third of all rows without a conversation or a turn, most of them equal: dealt apart, and still in order."""
    many = [(None, None, "ann", f"t{t % 2}") for t in range(900)] + [(None, 1, "bob", "w" * (t % 11)) for t in range(900)] + [(5, t, "ann", "x") for t in range(900)]
    assert rendered(rotate(frame(spark, many)).collect()) == plain(many)


def test_empty_table_and_other_speaker_column(spark):
    assert rotate(frame(spark, MESSAGES).limit(0)).collect() == []
    renamed = frame(spark, MESSAGES).withColumnRenamed("role", "speaker")
    assert rotate(renamed, speaker="speaker").count() == rotate(frame(spark, MESSAGES)).count()


def test_no_python_in_the_plan(spark):
    plan = rotate(frame(spark, MESSAGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")
