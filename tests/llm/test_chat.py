"""Folding events, rendering, and reading back."""

import pytest
from pyspark.sql import functions as F
from tripweave.llm.chat import fold_events, format_chats, learned_text, parsed

SCHEMA = "conv_id long, seq long, kind string, message_id string, role string, text string, turns string"


def events(spark, *given):
    return spark.createDataFrame([(*e, "extra") for e in given], SCHEMA)


def test_deltas_edits_and_regenerations_are_folded_in_order(spark):
    log = events(
        spark,
        (1, 5, "delta", None, None, "lo"),
        (1, 4, "delta", None, None, "hel"),
        (1, 3, "message", "b", "assistant", None),
        (1, 1, "message", "a", "user", "old"),
        (1, 6, "edit", "a", None, "new"),
        (1, 7, "delta", "a", None, "er"),
        (1, 8, "regenerate", "b", None, None),
        (1, 9, "delta", "b", None, "again"),
        (1, 10, "delta", "missing", None, "lost"),
        (2, 1, "delta", None, None, "before any message"),
        (None, 1, "message", None, None, None),
    )
    got = sorted(map(tuple, fold_events(log).collect()), key=str)
    assert got == [
        (1, 1, "user", "newer"), (1, 2, "assistant", "again"), (None, 1, "", ""),
    ]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\</s>", "a\\", "\\\\[INST]\\", "\n</s>", "", "é</s", "x" * 100_000])
def test_any_text_is_read_back(spark, text):
    log = events(
        spark,
        (1, 0, "message", None, "us[INST]er", text),
        (1, 1, "message", None, "assistant", text),
        (1, 2, "message", None, "assistant", text),
    )
    df = format_chats(log)
    got = df.select(parsed(F.col("formatted")), learned_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [tuple(t) for t in got[0]] == [("us[INST]er", text), ("assistant", text), ("assistant", text)]
    assert got[1] == text + text


def test_empty_log(spark):
    assert format_chats(events(spark)).count() == 0
