import pytest
from pyspark.sql import functions as F

from murmurlake.llm import chat_format

COLUMNS = ("conv_id", "fingerprint", "layout", "formatted", "loss_runs")


def test_turn_rows_need_no_variant(spark):
    rows = [(1, 2, "gpt", "b <#:\\>"), (1, 1, "human", "a"), (1, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 1, "user", "x"), (None, 1, "tool", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    direct = chat_format.format_rows(df)
    old = chat_format.format_chats(chat_format.records_of_rows(df))
    assert sorted(map(str, direct.select(*COLUMNS).collect())) == sorted(map(str, old.select(*COLUMNS).collect()))
    assert "json" not in direct._jdf.queryExecution().toString()


def test_a_large_record_that_does_not_parse_is_an_error(spark):
    record = F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit("broken"))
    small, large = (spark.createDataFrame([(n,)], "id long").select(record.alias("record")) for n in (10, chat_format.LARGE))
    assert chat_format.canonical_turns(small).first().turns is None
    with pytest.raises(Exception, match="(?i)malformed|variant"):
        chat_format.canonical_turns(large).select("layout").collect()
