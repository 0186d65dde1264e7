"""Chat formatting with Spark expressions only.

Template: each run of turns of one role is `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`;
the texts of adjacent turns of the same role stand in one such block with
`<|im_sep|>` between them. Strings that could be taken for control strings are
escaped inside texts and roles: a backslash becomes `\\b`, `<` before `|`,
`s>`, `/s>` or `<` becomes `\\l`, `[` before `INST]` or `/INST]` becomes `\\s`,
and a line feed in a role `\\n`. Every backslash of the output thus starts one
of these four, which makes the escape reversible.

Defined results: null texts and roles are empty; turns are sorted by turn (null
last), then role, then text; repeated rows stay; rows without conv_id form one
conversation with a null id; a conversation must fit a row of Spark; an empty
table gives no rows; columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, r"<(?=\||/?s>|<)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\s")


def unescape(text: Column) -> Column:
    for tag, char in (("\\n", "\n"), ("\\l", "<"), ("\\s", "["), ("\\b", "\\")):
        text = F.replace(text, F.lit(tag), F.lit(char))
    return text


def format_chats(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", loss_roles=("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans: the formatted conversation, and where the texts stand that count for the loss (1-based code points)."""
    turn = F.struct(
        F.col(turn_col).isNull().alias("late"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))).otherwise(F.lit(SEP))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"), t["role"].isin(*loss_roles).alias("loss"))

    cut = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    zero = F.struct(F.lit(1).alias("at"), F.expr("array()").cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("chars")))
        return F.struct((start + F.length(p["body"]) + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return cut.select("conv_id", text.alias("formatted"), F.aggregate("pieces", zero, step)["spans"].alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: what format_chats was given, read from its output alone."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring(b, F.lit(len(START) + 1), F.length(b))
        cut = F.instr(body, F.lit("\n"))
        role = unescape(F.substring(body, F.lit(1), cut - 1))
        return F.transform(F.split(F.substring(body, cut + 1, F.length(body)), r"<\|im_sep\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["chars"]))), "")
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_chats(format_chats(rows.unionByName(added)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS is_first, coalesce(lead(role) OVER w <> role, true) AS is_last,
             row_number() OVER w AS n,
             length(text) + len(regexp_extract_all(text, '\\')) + (len(text) - len(replace(text, '<|', '|')))
             + (len(text) - len(replace(text, '<s>', 's>'))) + (len(text) - len(replace(text, '</s>', '/s>'))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '<+'), lambda x: len(x) - 1)), 0)
             + (len(text) - len(replace(replace(text, '[INST]', 'INST]'), '[/INST]', '/INST]'))) AS escaped
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + CASE WHEN is_first THEN 13 + length(role) ELSE 10 END + CASE WHEN is_last THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
