"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is an array of parts: text, image, audio or document. A visitor flattens them in order: text is
escaped, every other part becomes its placeholder, and its reference and the tokens that it will expand to
are recorded. Turns are marked by control strings; all of them start with '<', and texts are escaped so
that none can be made by a text:

    <|start|>ROLE<|body|>PARTS<|end|>\\n

The escape is reversible: & becomes &amp;, < becomes &lt;, [ becomes &#91; (undone in the reverse order),
which also keeps markers of other templates out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import read_table

START, BODY, END = "<|start|>", "<|body|>", "<|end|>\n"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
UNKNOWN = "<|attachment|>"
PARTS = "array<struct<kind string, text string, uri string, width int, height int, seconds double, pages int>>"
#: Tokens: an image has one for each patch of 14 x 14 pixels, audio 25 a second, a document 256 a page.
PATCH, A_SECOND, A_PAGE = 14, 25, 256


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    none = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))


def _flat(part: Column) -> Column:
    shown = F.when(part.kind == "text", escape(part.text))
    for kind, mark in PLACEHOLDERS.items():
        shown = shown.when(part.kind == kind, F.lit(mark))
    return shown.otherwise(F.lit(UNKNOWN))


def _tokens(part: Column) -> Column:
    n = F.when(part.kind == "image", F.ceil(part.width / PATCH) * F.ceil(part.height / PATCH))
    n = n.when(part.kind == "audio", F.ceil(part.seconds * A_SECOND)).when(part.kind == "document", part.pages * A_PAGE)
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long")


def format_chats(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns(conv_id, turn, role, parts as in PARTS) -> one row per conversation.

    conv_id; formatted, the whole string; n_turns long; loss_spans, an array of (turn_index, start, length)
    in code points from the start of that rendered turn, the bodies of the roles to learn from;
    attachments, in order, an array of (turn_index, kind, uri, tokens); expanded_tokens long, their sum.

    A conversation is one string and so one row: one that is as long as a large share of the table takes the
    memory of its text. Defined results: turns go by turn (nulls first), then role, then the texts of
    their parts before escaping, so ties and repeated rows are kept in a fixed order; null roles, parts and texts are empty; a part of unknown kind
    becomes <|attachment|> with 0 tokens; a null conv_id is a conversation of its own; an empty table gives
    an empty table; other columns are ignored.
    """
    # texts first: ties go by the texts as they are, not as they are escaped
    parts = F.transform(
        F.coalesce("parts", F.array().cast(PARTS)),
        lambda p: F.struct(F.when(p.kind.eqNullSafe("text"), F.coalesce(p.text, F.lit(""))).alias("text"), *[p[c].alias(c) for c in ("kind", "uri", "width", "height", "seconds", "pages")]),
    )
    one = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    loose = lambda t: F.transform(F.filter(t.parts, lambda p: ~p.kind.eqNullSafe("text")), lambda p: F.struct(p.kind.alias("kind"), p.uri.alias("uri"), _tokens(p).alias("tokens")))
    one = one.select("conv_id", F.transform("ts", lambda t: F.struct(t.role.alias("role"), F.array_join(F.transform(t.parts, _flat), "").alias("body"), loose(t).alias("loose"))).alias("ts"))
    head = F.length(F.lit(START)) + F.length(F.lit(BODY))
    shown = F.transform("ts", lambda t: F.concat(F.lit(START), escape(t.role), F.lit(BODY), t.body, F.lit(END)))
    spans = F.filter(
        F.transform("ts", lambda t, i: F.struct(i.alias("turn_index"), (head + F.length(escape(t.role))).cast("long").alias("start"), F.length(t.body).cast("long").alias("length"), t.role.isin(*learn_from).alias("on"))),
        lambda s: s.on,
    )
    held = F.flatten(F.transform("ts", lambda t, i: F.transform(t.loose, lambda a: F.struct(i.alias("turn_index"), a.kind.alias("kind"), a.uri.alias("uri"), a.tokens.alias("tokens")))))
    return one.select(
        "conv_id",
        F.array_join(shown, "").alias("formatted"),
        F.size("ts").cast("long").alias("n_turns"),
        F.transform(spans, lambda s: F.struct(s.turn_index.alias("turn_index"), s.start.alias("start"), s.length.alias("length"))).alias("loss_spans"),
        held.alias("attachments"),
        F.aggregate(held, F.lit(0).cast("long"), lambda n, a: n + a.tokens).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The rendered turns of a formatted conversation, without their end marks."""
    cut = F.split(formatted, r"<\|end\|>\n")
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def turn_role(rendered: Column) -> Column:
    return unescape(F.substring_index(F.substr(rendered, F.lit(len(START) + 1)), BODY, 1))


def turn_body(rendered: Column) -> Column:
    return unescape(F.substring_index(rendered, BODY, -1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = chats.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    back = format_chats(turns).select("conv_id", "formatted", "loss_spans", read_turns(F.col("formatted")).alias("back"))
    learnt = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("back"), s.turn_index), (s.start + 1).cast("int"), s.length.cast("int")))), ""
    )
    told = F.array_join(F.transform("back", lambda t: F.concat(turn_role(t), F.lit("\n"), turn_body(t), F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + 4 * (length(role) - length(replace(role, '&', '')))
              + 3 * (length(role) - length(replace(role, '<', ''))) + 4 * (length(role) - length(replace(role, '[', ''))) AS er,
            length(text) + 4 * (length(text) - length(replace(text, '&', '')))
              + 3 * (length(text) - length(replace(text, '<', ''))) + 4 * (length(text) - length(replace(text, '[', ''))) AS et
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(er + et + length('<|start|><|body|><|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
