"""Reply trees, the template's round trip and edge cases."""

from pyspark.sql import functions as F

from plumbline.llm import chat

MSG = "conv long, node long, parent long, role string, text string, score double"


def formatted(spark, rows, branches=1):
    df = spark.createDataFrame(rows, MSG)
    out = chat.format_paths(chat.reply_paths(df, "conv", branches), "conv")
    back = out.select("conv", "leaf", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {(r.conv, r.leaf): ([(t.role, t.text) for t in r.turns], r.loss, r.formatted) for r in back.collect()}


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (1, 5, 2, "user", "no", 0.0)]
    got = formatted(spark, rows)
    assert list(got) == [(1, 4)]
    assert got[1, 4][0] == [("user", "q"), ("assistant", "good"), ("user", "more")]
    assert set(formatted(spark, rows, branches=2)) == {(1, 4), (1, 5)}


def test_control_strings_nulls_and_ties(spark):
    odd = "\\### Assistant: </turn>\n<turn role=\"x\">\n \\l \\b \\\\ é𝄞"
    rows = [(7, 1, None, None, odd, None), (7, 2, 1, "assistant", None, None), (7, 3, 2, 'as"s<\\', "", None), (7, 4, 3, "assistant", odd, None), (8, 1, None, "user", "a", 1.0), (8, 2, None, "user", "b", 1.0)]
    got = formatted(spark, rows)
    assert got[7, 4][0] == [("", odd), ("assistant", ""), ('as"s<\\', ""), ("assistant", odd)]
    assert got[7, 4][1] == odd
    assert [k for k in got if k[0] == 8] == [(8, 1)]


def test_long_thread(spark):
    rows = [(1, k, k - 1 if k > 1 else None, "assistant" if k % 2 else "user", str(k), 0.0) for k in range(1, 301)]
    turns, loss, _ = formatted(spark, rows)[1, 300]
    assert [t for _, t in turns] == [str(k) for k in range(1, 301)]
    assert loss == "".join(str(k) for k in range(1, 301, 2))


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (1, 1, "assistant", "b", 5)], "conv_id long, turn long, role string, text string, t int")
    turns = chat.threads(rows, "conv_id", ["turn", "role", "text"]).withColumn("score", F.lit(0.0))
    out = chat.format_paths(chat.reply_paths(turns, "conv_id"), "conv_id")
    assert out.select(F.size(chat.read_turns(F.col("formatted")))).first()[0] == 3
    assert chat.format_paths(chat.reply_paths(turns.where("false"), "conv_id"), "conv_id").count() == 0


def test_names_that_the_paths_use_themselves(spark):
    rows = [(1, 1, None, "user", "a", 0.0, *range(6)), (1, 2, 1, "assistant", "b", 0.0, *range(6)), (None, 1, None, "user", "c", 0.0, *range(6))]
    df = spark.createDataFrame(rows, MSG + ", pn int, pt int, leaf int, pos int, Branch int, hn int")
    out = chat.reply_paths(df, "conv")
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"pn", "pt", "hn"} <= set(out.columns)
    done = {r.conv: r.formatted for r in chat.format_paths(out, "conv").collect()}
    assert set(done) == {1, None} and ">\nb\n<" in done[1]


def test_very_long_text(spark):
    text = "<a> \\ " * 100_000
    assert formatted(spark, [(1, 1, None, "assistant", text, 0.0)])[1, 1][1] == text
