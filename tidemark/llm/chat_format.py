"""Chat formatting by a finite-state machine over roles and a declarative template (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """States with their marks, the moves between them, and the states whose text is under the loss.

    ``states`` gives for each state the role it takes, what opens and what closes its turn. ``moves`` lists the
    states that may follow a state ("start" before the first turn). A role that no such state takes is out of order:
    the machine then enters the first state for that role, or ``other`` if there is none, and the conversation is not
    valid. Every control string starts with ``<`` or ``[``; both, ``]`` and the escape sign are escaped inside texts,
    so no text can hold a control string and the formatted text can be read back.
    """

    states: dict[str, tuple[str, str, str]] = field(default_factory=lambda: {"system": ("system", "<<SYS>>", "<</SYS>>"), "user": ("user", "[INST]", "[/INST]"), "assistant": ("assistant", "<s>", "</s>")})
    other: tuple[str, str] = ("[ROLE:", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"user", "assistant"})


#: Escapes inside texts: the sign itself first, then what starts or ends a control string.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))
OTHER = "other"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _lookup(values: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def run_machine(turns: Column, template: Template = Template()) -> Column:
    """Fold the machine over the turns (role, ...): a struct of end state, ok, and path.

    ``path`` has one character a turn, the letter of the state entered; so the fold carries a short string instead
    of the segments, and a conversation of n turns costs n characters a step at most.
    """
    letters = {s: chr(0x61 + i) for i, s in enumerate([OTHER, *template.states])}
    legal = {f"{state}\n{template.states[to][0]}": to for state, after in template.moves.items() for to in reversed(after)}
    recover = {spec[0]: s for s, spec in reversed(template.states.items())}

    def step(at: Column, turn: Column) -> Column:
        known = _lookup(legal, F.concat(at["state"], F.lit("\n"), turn["role"]))
        state = F.coalesce(known, _lookup(recover, turn["role"]), F.lit(OTHER))
        return F.struct(state.alias("state"), (at["ok"] & known.isNotNull()).alias("ok"), F.concat(at["path"], _lookup(letters, state)).alias("path"))

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(True).alias("ok"), F.lit("").alias("path")), step)


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, end_state, segments (text, loss), formatted, loss_mask.

    The machine's path decides each turn's marks and loss flag. ``formatted`` is all segments one after the other and
    ``loss_mask`` their flags. Rows go by turn (ties by role, then text; null turns first). Null text is empty, a null
    role is the empty role; roles without a state get the general marks and make the order invalid, but nothing is
    dropped. A null conv_id is one conversation. Repeated rows are turns of their own; an empty table gives no rows.
    Further columns are ignored, whatever their names. A conversation is one output value, so its rows meet in one
    row; the partial lists are built before the shuffle.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("machine", run_machine(F.col("turns"), template))
    letters = {chr(0x62 + i): spec for i, spec in enumerate(template.states.values())}
    under = [chr(0x62 + i) for i, s in enumerate(template.states) if s in template.loss] + ["a"] * (OTHER in template.loss)

    def emit(t: Column, entered: Column) -> Column:
        start = F.coalesce(_lookup({k: v[1] for k, v in letters.items()}, entered), F.concat(F.lit(template.other[0]), escape(t["role"]), F.lit("]")))
        end = F.coalesce(_lookup({k: v[2] for k, v in letters.items()}, entered), F.lit(template.other[1]))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(start, F.lit(False)), seg(escape(t["text"]), entered.isin(*under) if under else F.lit(False)), seg(end, F.lit(False)))

    path = F.filter(F.split("machine.path", ""), lambda x: x != "")
    out = chats.withColumn("segments", F.flatten(F.zip_with("turns", path, emit)))
    valid = F.col("machine.ok") & F.col("machine.state").isin(*template.final)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), F.col("machine.state").alias("end_state"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.transform("segments", lambda s: s["loss"]).alias("loss_mask"))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_text`` parsed from ``formatted``; the mask says which parts are loss text."""
    quote = lambda s: "".join("\\" + c if c in "[]<>/\\" else c for c in s)
    opens = "|".join([quote(o) for _, o, _ in template.states.values()] + [quote(template.other[0]) + r"[^\[\]<]*\]"])
    closes = "|".join(quote(c) for c in [*(c for _, _, c in template.states.values()), template.other[1]])
    pattern = rf"({opens})([^\[<]*)({closes})"
    roles = {o: r for r, o, _ in template.states.values()}

    def turn(mark: Column, text: Column) -> Column:
        own = unescape(F.substring(mark, F.lit(len(template.other[0]) + 1), F.length(mark) - len(template.other[0]) - 1))
        return F.struct(F.coalesce(_lookup(roles, mark), own).alias("role"), text.alias("text"))

    found = lambda k: F.regexp_extract_all("formatted", F.lit(pattern), F.lit(k))
    parsed = chats.withColumn("texts", F.transform(found(2), unescape)).withColumn("turns", F.zip_with(found(1), "texts", turn))
    # The mask has a flag for each opening, text and closing; those of texts are every third from the second on.
    flags = F.filter("loss_mask", lambda _, i: i % 3 == 1)
    under = F.zip_with("texts", flags, lambda text, loss: F.when(loss, text).otherwise(F.lit("")))
    return parsed.withColumn("loss_text", F.array_join(under, "")).drop("texts")
