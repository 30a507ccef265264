"""Chat formatting: field-path fingerprints choose a declarative mapping to canonical turns.

A record is one JSON text in any registered layout.  The nested field paths
that it has among those that any layout knows are hashed; the hash picks the
mapping that turns the record into ``array<struct<role, content>>``.  Fields
that no layout knows do not count and are left out.  The template then writes
each turn as ``<s>`` role ``[INST]`` text ``</s>``; in roles and texts ``\\``,
``<`` and ``[`` are written ``\\\\``, ``\\l`` and ``\\b``, so no control string
occurs inside one and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role:string,content:string>>"
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "</s>"
#: Loss spans that are read back from the text as it is; more are read from fixed-width code points.
FEW_SPANS = 64

#: The fields that layouts know; a record is read by this schema, so texts have no limit but that of a string.
FIELDS = {
    "messages": _TURNS, "conversations": "array<struct<from:string,value:string>>", "prompt": "string", "completion": "string", "question": "string",
    "answer": "string", "instruction": "string", "input": "string", "output": "string", "system": "string",
}
_PAIR = "array(named_struct('role', 'user', 'content', {}), named_struct('role', 'assistant', 'content', {}))"
#: Layout name: example records, each of other field paths, as these are what counts (a null field is an absent one), and the SQL that maps the fields to turns.
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (
        ('{"messages":[{"role":"a","content":"a"}]}', '{"messages":[{"role":"a"}]}', '{"messages":[{"content":"a"}]}', '{"messages":[]}'), "messages"
    ),
    "sharegpt": (
        ('{"conversations":[{"from":"a","value":"a"}]}', '{"conversations":[{"from":"a"}]}', '{"conversations":[{"value":"a"}]}', '{"conversations":[]}'),
        """transform(conversations, t -> named_struct('role', case t.from when 'human' then 'user' when 'gpt' then 'assistant' else t.from end, 'content', t.value))""",
    ),
    "prompt": (('{"prompt":"a","completion":"a"}', '{"prompt":"a"}', '{"completion":"a"}'), _PAIR.format("prompt", "completion")),
    "question": (('{"question":"a","answer":"a"}',), _PAIR.format("question", "answer")),
    "instruction": (
        ('{"instruction":"a","input":"a","output":"a"}', '{"instruction":"a","output":"a"}'), _PAIR.format("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output")
    ),
    "system_instruction": (
        ('{"system":"a","instruction":"a","output":"a"}', '{"system":"a","instruction":"a","input":"a","output":"a"}'),
        "concat(array(named_struct('role', 'system', 'content', system)), " + _PAIR.format("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output") + ")",
    ),
}


def read_record(record: Column) -> Column:
    """The known fields of a JSON record as a struct; null for what is no JSON object."""
    return F.from_json(record, ", ".join(f"`{name}` {kind}" for name, kind in FIELDS.items()), {"maxStringLen": "2147483647"})


def _some(items: Column, field: str) -> Column:
    return F.exists(items, lambda x: x[field].isNotNull())


def field_paths(fields: Column) -> Column:
    """The nested paths that a record has of the known ones, in the order of FIELDS; null for no record."""
    paths = []
    for name, kind in FIELDS.items():
        value = fields.getField(name)
        paths.append(F.when(value.isNotNull(), name))
        if kind.startswith("array<struct<"):
            inner = [f.split(":")[0] for f in kind.removeprefix("array<struct<").removesuffix(">>").split(",")]
            paths += [F.when(_some(value, f), f"{name}[].{f}") for f in inner]
    return F.when(fields.isNotNull(), F.array_join(F.array_compact(F.array(*paths)), " "))


def fingerprint(fields: Column) -> Column:
    return F.xxhash64(field_paths(fields))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes part the text; in between, the two letters stand for their signs."""
    piece = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def records_from_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: the rows of a conversation, by turn, as one JSON record.

    Ties of ``turn`` are ordered by role, then text.  A null role or text is an
    absent field.  Of a user's and an assistant's text alone the record is a
    prompt with its completion; where all roles are known and the id is odd, it
    is a list of conversations, else one of messages.  One conversation is one
    output string, so its rows meet in one task; a conversation is bounded by
    what one formatted text may be.
    """
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    other = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "system")))
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    said = F.transform("t", lambda t: F.struct(F.try_element_at(other, t["role"]).alias("from"), t["content"].alias("value")))
    pair = (roles == F.array(F.lit("user"), F.lit("assistant"))) & F.forall("t", lambda t: t["content"].isNotNull())
    plain = F.forall("t", lambda t: F.coalesce(t["role"].isin("user", "assistant", "system"), F.lit(False))) & (F.pmod(F.col("conv_id"), F.lit(2)) == 1)
    record = (
        F.when(pair, F.to_json(F.struct(F.col("t")[0]["content"].alias("prompt"), F.col("t")[1]["content"].alias("completion"))))
        .when(plain, F.to_json(F.struct(said.alias("conversations")))).otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return whole.select("conv_id", record.alias("record"))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """``id, layout, idx, role, content`` rows; null fields become empty strings.

    Fields beside those of a layout are left out.  Records of no one layout, or
    that are no JSON, keep one row with null ``layout`` and ``idx``, so they can
    be counted and nothing is lost silently.
    """
    spark = records.sparkSession
    known = [F.struct(F.lit(name).alias("layout"), F.lit(text).alias("example")) for name, (examples, _) in LAYOUTS.items() for text in examples]
    registry = spark.range(1).select(F.inline(F.array(*known))).select("layout", fingerprint(read_record(F.col("example"))).alias("fingerprint"))
    parsed = records.select(F.col(id_col).alias("id"), read_record(F.col(record_col)).alias("r"))
    parsed = parsed.select("id", "r.*", F.when(F.col("r").isNotNull(), fingerprint(F.col("r"))).alias("fingerprint"))
    chosen = parsed.join(F.broadcast(registry), "fingerprint", "left")  # the registry is the constant above
    turns = F.lit(None).cast(_TURNS)
    for name, (_, mapping) in LAYOUTS.items():
        turns = F.when(F.col("layout") == name, F.expr(mapping)).otherwise(turns)
    exploded = chosen.select("id", "layout", F.posexplode_outer(turns).alias("idx", "t"))
    return exploded.select(
        "id", "layout", "idx", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.content", F.lit("")).alias("content")
    )


def format_chat(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """``id, layout, formatted, loss_spans``: one row per record id.

    ``loss_spans`` lists (start, length) code points of the escaped assistant
    texts in ``formatted``.  Empty conversations and unknown layouts give an
    empty text.  Records that share an id are formatted one after another in
    no stated order; give each its own id.
    """
    from pyspark.sql import Window

    role, text = escape(F.col("role")), escape(F.col("content"))
    rows = canonical_turns(records, id_col, record_col).select(
        "id", "layout", "idx",
        F.when(F.col("idx").isNull(), F.lit("")).otherwise(F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))).alias("part"),
        (F.length(role) + len(OPEN) + len(MIDDLE)).cast("long").alias("lead"),
        F.length(text).cast("long").alias("size"),
        (F.col("role") == "assistant").alias("loss"),
    )
    before = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.col("lead"))
    listed = F.array_sort(F.collect_list(F.struct("idx", "part", "start", "size", "loss")))
    whole = rows.groupBy("id").agg(F.first("layout").alias("layout"), listed.alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"] & x["idx"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))
    return whole.select("id", "layout", F.array_join(F.transform("t", lambda x: x["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``id, turns array<struct<role, content>>, loss_text``, parsed from the output alone."""
    marked = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    inner = F.transform(marked, lambda x: F.split(F.substring(x, len(OPEN) + 1, 2147483647), r"\[INST\]", -1))
    turns = F.transform(inner, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("content")))
    first, size = (lambda s: (s["start"] + 1).cast("int")), (lambda s: s["size"].cast("int"))
    few = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), first(s), size(s))))
    # a place in UTF-8 is found by counting from the start, in four bytes a code point at once; the mark in front keeps one in the text
    wide = lambda t, s: F.concat(F.unhex(F.lit("0000FEFF")), F.substring(t, (first(s) - 1) * 4 + 1, size(s) * 4))
    many = lambda t: F.transform("loss_spans", lambda s: unescape(F.decode(wide(t, s), "UTF-32")))
    encoded = F.get(F.transform(F.array(F.encode("formatted", "UTF-32")), many), F.lit(0))
    loss = F.when(F.size("loss_spans") <= FEW_SPANS, few).otherwise(encoded)
    return formatted.select("id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
