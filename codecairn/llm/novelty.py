"""Secrets by pattern, and by novelty under zstandard primed with the surroundings.

A candidate is a long token after a sensitive word: on its line, on the next, or on lines of one token that follow these. What it costs is the growth of the compressed
text when it is appended to its surroundings, with common words, common identifiers, and the document without its candidates as
the dictionary (so a secret that is repeated stays novel). Natural words and identifiers are cheap then; random strings cost almost a byte a character.

Rows: one per input row; a null text counts as empty (no spans), texts are searched whole, repeated rows and
ties are judged each by itself, doc_id is passed through, other columns are not read. Spans count code
points, end exclusive, and are ordered by start, then by kind in the order of ``KINDS``.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, types as T

from codecairn.llm.tables import fields, map_rows, table, typed

#: Kinds, patterns of the base rules and the least length of what they capture.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # runs are maximal, so this equals dropping the short runs of [0-9a-f]+
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Sensitive context, and candidates after it on the same line.
CONTEXT = re.compile(rb"password|passwd|passphrase|pwd|secret|token|credential|bearer|authorization|"
                     rb"api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?id", re.I)
CONTEXT_WORDS = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"credential", b"bearer", b"authorization", b"key",
                 b"client")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.-]{16,}")
#: A line that is one token: it goes on with the value of the line before.
BODY = re.compile(rb"[ \t]*[\"']?[A-Za-z0-9+/_=.-]{16,}[\"',;\\]*[ \t\r]*")
#: Bytes of text on either side that prime the dictionary as they are; of the rest of the text, what it shares with the candidate in
#: runs of ``SHARED`` bytes and more.
AROUND, SHARED = 2048, 6
#: Least marginal bytes per candidate byte. Random strings of letters and digits cost 0.93 and more, identifiers up to 0.7.
NOVELTY = 0.85


def identifiers() -> bytes:
    """Common identifiers, made by joining verbs, adjectives and nouns in the usual spellings."""
    first = "get set user client server access refresh api auth session default admin test service private public".split()
    then = "token secret password key name value config path handler manager service request response context".split()
    words = [f(a, b) for a in first for b in then
             for f in (lambda a, b: a + "_" + b, lambda a, b: a + b.capitalize(), lambda a, b: (a + "_" + b).upper())]
    return " ".join(words).encode()


#: Words and word parts of prose and code.
WORDS = """ability access account action active address admin administration agent algorithm allow analysis android annotation anonymous another apache
application architecture archive argument array assertion assign async attribute audit authentication authorization authority available backend background backup
balance barrier base batch before between binary boolean boundary browser bucket buffer builder button cache calculate callback cancel category center certificate
change channel character check children class cleanup client cloud cluster collection column command comment commit common communication company compare compatible
complete component compression computer condition config configuration confirm confirmation connect connection console constant constraint construct consumer contact container content
context continue contract control controller conversion cookie coordinate count counter country create creation credential currency current custom customer
dashboard database dataset debug decode decorator default definition delegate delete delivery dependency deployment description desktop destination detail
development device dialog dictionary different digest directory disable discovery display distribution document domain download driver dynamic editor effective element email embedded
empty enable encode encoding encryption endpoint engine entity entry environment error event example exception exchange execute execution expire expiration explicit
export expression extension external factory failure feature field file filter final folder following forgot format forward framework function gateway general
generate generation generator global government graphic group handler hardware header health hidden history identifier identity image implementation import important include
index information infrastructure initial input insert inspector instance institution instruction integer integration interface internal international internet interval invalid invoice issue
iterator javascript keyboard language latest launch layout library license limit listener literal loader local location logger login logout machine maintenance manage management manager
manifest manual mapping market master material maximum member memory menu message metadata method microsoft middleware migration minimum mobile model module monitor
multiple namespace native navigation network never nothing notification number object observer office official operation operator option order organization original
output overview owner package parameter parent parser partition passphrase password patch pattern payment performance permission person personal phone pipeline platform player plugin
pointer policy position possible prefix preference prepare present preview previous primary principal private procedure process processor product production profile program progress project
property protected protocol provider proxy public publisher purchase python quality query question queue random range reader receive recommend record recover recovery redirect
reference refresh region register registration registry relation release remote remove render replace report repository request require required reset resolve resource respond response
responsibility responsible restore result return review revision rotation route router running runtime sample schedule scheduler schema scope screen script search second secret section
secure security select selection sensitive separate sequence serial serializer server service session setting setup shared should signature simple single snapshot social software source special
specific specification standard start state statement static station statistics status storage store stream string structure student style subject submit subscription success
summary support surface switch symbol synchronize syntax system table target template temporary terminal test text theme thread through timeout timestamp together token tool topic total
trace track transaction transfer transform transition translate transport trigger type undefined under understand unique united university unknown unsigned update upload upper usage user username
utility validate validation validator value variable vendor verify verification version video view virtual visible volume warning website where which widget window without worker
workflow workspace wrapper write writer yourself
ization ational ibility ability ically ication ification ement ment ness less tion sion ingly ously iously ative istic ologist ology ographic ometer counter inter super
trans under over multi micro hyper electro psycho photo anti auto semi para pseudo extra ultra"""


@lru_cache(maxsize=1)
def _identifiers() -> bytes:
    """Common words in three cases, and common identifiers."""
    words = WORDS.split()
    return " ".join(f(w) for f in (str.upper, str.capitalize, str.lower) for w in words).encode() + b" " + identifiers()


class Runs:
    """The runs of ``SHARED`` bytes of a text with their places, sorted once; candidates are looked up in it."""

    def __init__(self, text: bytes):
        self.text = np.frombuffer(text, np.uint8)
        n = max(0, len(text) - SHARED + 1)
        padded = np.frombuffer(text + bytes(8), np.uint8)
        grams = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n,), (1,)) & np.uint64((1 << 8 * SHARED) - 1) if n else np.empty(0, np.uint64)
        self.at = np.argsort(grams, kind="stable")
        self.grams = grams[self.at]

    def longest(self, candidate: bytes, at: int) -> int:
        """The most bytes from ``at`` on that stand somewhere in the text; 0 if fewer than ``SHARED`` do."""
        gram = np.uint64(int.from_bytes(candidate[at:at + SHARED], "little"))
        first, end = np.searchsorted(self.grams, gram), np.searchsorted(self.grams, gram, side="right")
        if first == end:
            return 0
        places, n = self.at[first:end] + SHARED, SHARED
        while at + n < len(candidate):
            places = places[places < len(self.text)]
            places = places[self.text[places] == candidate[at + n]] + 1
            if not len(places):
                break
            n += 1
        return n

    def shared(self, candidate: bytes) -> bytes:
        """The longest runs of the candidate, from left to right, that the text has too."""
        runs, at = [], 0
        while at + SHARED <= len(candidate):
            if n := self.longest(candidate, at):
                runs.append(candidate[at:at + n])
            at += n or 1
        return b" ".join(runs)


def novelty(candidate: bytes, before: bytes, after: bytes) -> float:
    """Marginal compressed bytes per byte of the candidate, given its surroundings and the identifiers."""
    primed = zstandard.ZstdCompressionDict(_identifiers() + b" " + after + b" " + before,
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
    context = before[-64:]
    return (len(z.compress(context + candidate)) - len(z.compress(context))) / len(candidate)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the pattern rules."""
    spans = []
    if any(w in (low := data.lower()) for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in data:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    return spans


def novel_spans(data: bytes, known: list[tuple[int, int, int]], least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of incompressible strings in sensitive context that no known span touches."""
    low = data.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    spans: set[tuple[int, int]] = set()
    done = 0
    for word in CONTEXT.finditer(data):
        if m := CANDIDATE.match(data, word.end()):
            spans.add(m.span())
        stop = scope_end(data, word.end(), done)
        at = max(word.end(), done)
        while (m := CANDIDATE.search(data, at, stop)):
            m = CANDIDATE.match(data, m.start())
            spans.add(m.span())
            at = m.end()
        done = max(done, stop)
    others = bytearray(data)  # the document without its candidates
    for s, e in spans:
        others[s:e] = b" " * (e - s)
    text = bytes(others)
    known_at = sorted(known)
    starts, ends = [a for a, _, _ in known_at], list(accumulate((z for _, z, _ in known_at), max))
    out, runs = [], None
    for s, e in sorted(spans):
        before_end = bisect_left(starts, e)
        if before_end and ends[before_end - 1] > s:  # some known span begins before this one's end and ends after its start
            continue
        runs = runs or Runs(text)
        candidate = data[s:e]
        before, after = text[max(0, s - AROUND):s], text[e:e + AROUND]
        if novelty(candidate, runs.shared(candidate) + b" " + before, after) >= least:
            out.append((s, e, 3))
    return out


def scope_end(data: bytes, at: int, done: int = 0) -> int:
    """Where the statement of a sensitive word ends: after the next line and the lines of one token behind it. ``done`` is the end of
    the one before: where the next line lies in that, both end together."""
    end = data.find(b"\n", at)
    if 0 <= end < done and 0 <= data.find(b"\n", end + 1) <= done:
        return done
    lines = 0
    while end >= 0:
        after = data.find(b"\n", end + 1)
        lines += 1
        if lines > 1 and not BODY.fullmatch(data, end + 1, after if after >= 0 else len(data)):
            return end
        end = after
    return len(data)


def secret_spans(text: str | None, least: float = NOVELTY) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered."""
    data = (text or "").encode()
    spans = base_spans(data)
    spans = sorted(spans + novel_spans(data, spans, least), key=lambda s: (s[0], s[2], s[1]))
    if len(data) == len(text or ""):
        return [(KINDS[k], s, e) for s, e, k in spans]
    out, at, chars = [], 0, 0
    for s, e, k in spans:
        chars, at = chars + len(data[at:s].decode()), s
        out.append((KINDS[k], chars, chars + len(data[s:e].decode())))
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    schema = T.StructType([*fields(docs, "doc_id"), *typed(
        "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")])

    def task(rows):
        for b in rows:
            found = [secret_spans(t, least) for t in b.column(1).to_pylist()]
            n = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(_listed([s for s in f if s[0] != "novel"]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *n[:3], pa.array(base, pa.string()),
                                              pa.array(map(_listed, found), pa.string()), n[3]], schema.names)

    return map_rows(docs, ["doc_id", "text"], schema, task)


def masked(text: str | None, least: float = NOVELTY, mark: str = "[secret]") -> str | None:
    """The text with each span, or each run of overlapping spans, replaced."""
    spans = secret_spans(text, least)
    if not spans:
        return text
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """The same rows and columns with secrets masked in ``text``, and ``n_chars`` following it where it changed."""
    names = docs.columns

    def task(rows):
        for b in rows:
            old = b.column(names.index("text")).to_pylist()
            new = [masked(t, least) for t in old]
            columns = {n: b.column(i) for i, n in enumerate(names)}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if a == z else len(z) for k, a, z in zip(kept, old, new)],
                                              columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return map_rows(docs, names, T.StructType(fields(docs, *names)), task)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
