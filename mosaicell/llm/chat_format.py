"""Chat formatting: a state machine over roles and a declarative template. DataFrame operations only.

Each turn becomes three segments: the role's opening marker, the text and the closing marker.
Only the texts of roles named in ``loss_roles`` carry a loss flag. Control strings inside texts
(and inside unknown role names) are escaped by a backslash after their first bracket(s), and one
more where backslashes stand there already, so that no control string of the template can occur
in a text and `unescape` restores each text exactly.

Roles outside the template are written by name in a generic turn. The machine's verdict on turn
order is the column `valid`; conversations are formatted either way.

Defined results: null texts and roles count as empty; turns are ordered by (turn, role, text),
null turns first, so ties and repeated rows have one order; rows with a null conv_id form one
conversation; an empty table gives an empty result; further columns are ignored. A conversation
is the unit of output, so one row holds one whole conversation, however long its texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers of each role, roles with loss, and the machine's moves (state, role) -> state."""

    markers: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("user", "assistant")


#: Escaped where a bracket is followed by any number of backslashes and one of these.
_TAILS = r"(?:/?INST\]|/?ROLE\]|TEXT\]|/?s>|/?SYS>>)"
_RAW = rf"(\[|<<?)(\\*+)({_TAILS})"
_ESCAPED = rf"(\[|<<?)\\(\\*+)({_TAILS})"


def escape(text) -> F.Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescape(text) -> F.Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _segment(kind: str, role, text, loss) -> F.Column:
    return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"), loss.alias("loss"))


def _turn_segments(t: Template):
    def segments(turn):
        role = turn["role"]
        opening = F.concat(F.lit(t.other[0]), escape(role), F.lit(t.other[1]))
        closing = F.lit(t.other[2])
        for name, (a, b) in t.markers.items():
            opening = F.when(role == name, F.lit(a)).otherwise(opening)
            closing = F.when(role == name, F.lit(b)).otherwise(closing)
        off = F.lit(False)
        return F.array(
            _segment("open", role, F.concat(opening, F.lit(" ")), off),
            _segment("text", role, escape(turn["text"]), role.isin(*t.loss_roles)),
            _segment("close", role, F.concat(F.lit(" "), closing), off),
        )

    return segments


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, segments, formatted, valid."""
    t = template or Template()
    empty = F.lit("")
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    chats = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}|{role}", to)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("|"), x["role"])), F.lit("invalid")))
    chats = chats.withColumn("segments", F.flatten(F.transform("turns", _turn_segments(t)))).withColumn("valid", state.isin(*t.final))
    return chats.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns(role, text) as parsed from `formatted`, and loss_text from the loss mask."""
    t = template or Template()
    quote = lambda xs: "|".join(r"\Q" + x + r"\E" for x in xs)
    opens = quote([t.other[0], *[a for a, _ in t.markers.values()]])
    closes = quote([t.other[2], *[b for _, b in t.markers.values()]])
    pattern = F.lit(rf"(?s)({opens})(.*?)({closes})")
    names = F.create_map(*[F.lit(x) for role, (a, _) in t.markers.items() for x in (a, role)])

    def turn(opening, body):
        inner = F.when(opening == t.other[0], F.substring_index(body, t.other[1], -1)).otherwise(body)
        role = F.coalesce(F.try_element_at(names, opening), unescape(F.substring_index(body, t.other[1], 1)))
        return F.struct(role.alias("role"), unescape(F.substr(inner, F.lit(2), F.length(inner) - 2)).alias("text"))

    spans = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "conv_id",
        "formatted",
        "valid",
        F.zip_with(F.regexp_extract_all("formatted", pattern, F.lit(1)), F.regexp_extract_all("formatted", pattern, F.lit(2)), turn).alias("turns"),
        F.array_join(F.transform(spans, lambda s: unescape(s["text"])), "").alias("loss_text"),
    )


def digest(chats: DataFrame) -> DataFrame:
    """The columns of the contract, from what `read_back` gives."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(regexp_replace(text, '(\[|<<?)(\\*)(/?INST\]|/?ROLE\]|TEXT\]|/?s>|/?SYS>>)', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
      ELSE 21 + length(regexp_replace(role, '(\[|<<?)(\\*)(/?INST\]|/?ROLE\]|TEXT\]|/?s>|/?SYS>>)', '\1\\\2\3', 'g')) END AS n
  FROM t
), m AS (
  SELECT conv_id, string_agg(role, '>' ORDER BY turn NULLS FIRST, role, text) AS roles,
    CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, regexp_full_match(roles, '(system>)?user(>assistant>user)*(>assistant)?') AS valid
FROM m
"""
