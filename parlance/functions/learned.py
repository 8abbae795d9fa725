"""Text learning and recovery. Python (Arrow-batched) for correction learning, JSON recovery and keys; blocks and marks by built-ins."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def corrected_phrases(old: str | None, new: str | None) -> list[str]:
    """Phrases that an edit put in, worth remembering, sorted."""
    if not old or not new or old.strip() == new.strip():
        return []
    before, after = old.split(), new.split()
    found = set()
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, before, after).get_opcodes():
        phrase, was = " ".join(after[j1:j2]), " ".join(before[i1:i2])
        small = op == "insert" or (op == "replace" and abs(len(phrase) - len(was)) < len(was))
        if small and 2 <= len(phrase) < 100 and not (phrase.islower() and len(phrase) < 5):
            found.add(phrase)
    return sorted(found)


@F.pandas_udf(ArrayType(StringType()))
def learned_terms(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([corrected_phrases(a, b) for a, b in zip(old, new, strict=True)])


def bracketed(text: str) -> list[tuple[int, int]]:
    """Bracketed spans by depth, by their start; brackets inside of strings do not count.

    One pass with a stack. A quote that nothing closes opens no string: the pass goes on behind it, once more.
    """
    spans, at = [], 0
    for _ in range(2):
        stack, quote, k = [], None, at
        while k < len(text):
            c = text[k]
            if quote is not None:
                k += c == "\\"
                quote = None if c == '"' else quote
            elif c == '"':
                quote = k if stack else None  # a string stands in a value
            elif c in "[{":
                stack.append(k)
            elif c in "]}" and stack:
                spans.append((stack.pop(), k + 1))
            k += 1
        if quote is None:
            break
        at = quote + 1
    return sorted(set(spans), key=lambda s: (s[0], -s[1]))


def json_spans(text: str) -> Iterator[str]:
    """Where a value may be, best first: the whole answer, what fences hold, any bracketed span."""
    yield text
    inner = text.split("```")[1:]
    yield from (re.sub(r"\A\s*(json)?\s*", "", x) for x in inner if re.match(r"\s*(json)?\s*[\[{]", x))
    yield from (text[a:b] for a, b in bracketed(text))


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def recovered_json(text: str | None) -> str | None:
    """The JSON value in a model's answer, as compact text with sorted keys; null if there is none.

    Thoughts are not searched. Numbers that are not finite are no JSON, written as such or too large.
    """
    for span in json_spans(re.sub(r"(?s)<think>.*?</think>", "", text or "").strip()):
        try:
            return json.dumps(json.loads(span, parse_constant=_refuse), ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)
        except (ValueError, RecursionError):
            pass
    return None


@F.pandas_udf(StringType())
def json_from_answer(text: pd.Series) -> pd.Series:
    return text.map(recovered_json, na_action="ignore")


def answer_json(text) -> Column:
    """``recovered_json`` of a column: one writer, however the value is wrapped."""
    return json_from_answer(F.col(text) if isinstance(text, str) else text)


# --- inline marks and blocks: built-in functions only -------------------------------------------------

MARKED = r"(\*\*\*.*?\*\*\*|\*\*.*?\*\*|\*.*?\*|[^*]+|\*)"


def inline_runs(text) -> Column:
    """(text, bold, italic) runs: three, two or one star around a span; stars without a partner are text."""
    marked = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(MARKED), F.lit(0))

    def starred(t):
        """A token beside its stars a side; a token that ends with a star begins with one, or is that star."""
        around = lambda n: t.startswith("*" * n) & t.endswith("*" * n) & (F.length(t) >= 2 * n)
        stars = F.when(~t.startswith("*"), 0).when(around(3), 3).when(around(2) | (t == "**"), 2).when(around(1), 1).otherwise(0)
        return F.struct(t.alias("t"), stars.alias("stars"))

    def run(s):
        t, stars = s["t"], s["stars"]
        return F.struct(F.substring(t, stars + 1, F.greatest(F.length(t) - 2 * stars, F.lit(0))).alias("text"), (stars >= 2).alias("bold"), stars.isin(1, 3).alias("italic"), (stars == 0).alias("plain"))

    def join(done, r):
        last = F.element_at(done, -1)
        both = F.struct(F.concat(last["text"], r["text"]).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(True).alias("plain"))
        return F.when((F.size(done) > 0) & F.get(done, F.size(done) - 1)["plain"] & r["plain"], F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), both)).otherwise(F.array_append(done, r))

    none = F.array().cast("array<struct<text:string,bold:boolean,italic:boolean,plain:boolean>>")
    shown = lambda r: F.struct(r["text"].alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"))

    def runs(tokens):
        known = F.transform(tokens, starred)
        joined = F.aggregate(F.transform(known, run), none, lambda done, r: F.when(F.size(done) == 0, F.array(r)).otherwise(join(done, r)))
        # Only a star without a partner leaves text beside text, so most texts need no fold.
        return F.when(F.array_contains(tokens, "*"), F.transform(joined, shown)).otherwise(F.transform(known, lambda s: shown(run(s))))

    # An array of one: its element is worked out once, however often the function names it.
    return F.get(F.transform(F.array(marked), runs), 0)


#: Kinds of a protocol's lines, the first that fits; fixed values.
LINE_KINDS = [("blank", r"^$"), ("rule", r"^(-{3,}|\*{3,}|_{3,})$"), ("heading", r"^#{1,4}\s+.*$"), ("section", r"^§\s*\d+.*$"), ("bullet", r"^[-*]\s+.*$"), ("number", r"^\d+\.\s+.*$"), ("decision", "DECISION:"), ("action", "ACTION:")]
#: Lines that end a paragraph.
BREAKS = r"^$|^#|^- |^\* |^\d+\.\s|^§\s*\d+|^(-{3,}|\*{3,}|_{3,})$"


def block_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per block of ``text``: keys, block number, kind, level, mark, text, runs.

    Lines fall into islands that a breaking line opens. Within an island, its first plain line and all that
    follows are one paragraph; highlighted lines before it stand alone.
    """
    line = F.trim("line")
    kind = F.lit("paragraph")
    for name, pattern in reversed(LINE_KINDS):
        kind = F.when(line.rlike(pattern), name).otherwise(kind)
    rows = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    rows = rows.select(*keys, "pos", line.alias("line"), kind.alias("kind"), line.rlike(BREAKS).alias("breaks"))
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("island", F.sum(F.col("breaks").cast("int")).over(w))
    plain = F.min(F.when(F.col("kind") == "paragraph", F.col("pos"))).over(Window.partitionBy(*keys, "island"))
    rows = rows.withColumn("start", F.when(F.col("pos") >= plain, plain).otherwise(F.col("pos"))).where("kind <> 'blank'")
    g = rows.groupBy(*keys, "start").agg(F.min(F.struct("pos", "kind"))["kind"].alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("line"))
    body = (
        F.when(F.col("kind") == "heading", F.trim(F.regexp_replace(F.regexp_extract("line", r"^#{1,4}\s+(.*)$", 1), r"^\*+|\*+$", "")))
        .when(F.col("kind") == "rule", "").when(F.col("kind") == "bullet", F.regexp_extract("line", r"^[-*]\s+(.*)$", 1)).when(F.col("kind") == "number", F.regexp_extract("line", r"^\d+\.\s+(.*)$", 1)).otherwise(F.col("line"))
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"^(#{1,4})", 1))).when(F.col("kind") == "section", 2).otherwise(0)
    said = F.when(F.col("text").contains("DECISION:"), "decision").when(F.col("text").contains("ACTION:"), "action")
    mark = F.when(F.col("kind").isin("decision", "action"), F.col("kind")).when(F.col("kind") == "bullet", said)
    strong = F.col("kind").isin("decision", "action")
    out = g.select(*keys, "start", "kind", level.alias("level"), body.alias("text"), strong.alias("strong")).withColumn("mark", mark)
    runs = F.transform(inline_runs("text"), lambda r: F.struct(r["text"].alias("text"), (r["bold"] | F.col("strong")).alias("bold"), r["italic"].alias("italic")))
    shown = F.when(F.col("kind") == "section", "heading").when(F.col("strong"), "paragraph").otherwise(F.col("kind"))
    out = out.withColumns({"runs": runs, "block": F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1}).withColumn("kind", shown)
    return out.select(*keys, "block", "kind", "level", "mark", "text", "runs")


def recording_key(password: str, salt: bytes, rounds: int = 480_000) -> bytes:
    """256-bit key of one recording (PBKDF2, SHA-256)."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(c, key: bytes) -> Column:
    """AES-GCM, base64; null stays null."""
    return F.base64(F.aes_encrypt(F.col(c) if isinstance(c, str) else c, F.lit(key), F.lit("GCM")))


def decrypted(c, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(F.col(c) if isinstance(c, str) else c), F.lit(key), F.lit("GCM")).cast("string")


VERIFY = "parlance-verify"


def verify_token(key: bytes) -> Column:
    """A token by which a password can be checked later."""
    return encrypted(F.lit(VERIFY), key)


def opens(token, key: bytes) -> Column:
    """Whether the key opens a verification token; a token that it cannot open is no error."""
    plain = F.try_aes_decrypt(F.unbase64(F.col(token) if isinstance(token, str) else token), F.lit(key), F.lit("GCM")).cast("string")
    return F.coalesce(plain == VERIFY, F.lit(False))


def acceptable_password(password, repeated) -> Column:
    """At least four characters, given twice alike."""
    p, r = (F.col(x) if isinstance(x, str) else x for x in (password, repeated))
    return F.coalesce((F.length(p) >= 4) & (p == r), F.lit(False))
