"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

Three patterns give the base spans: assignments to a telling name, access keys and
long hex strings.  Beyond them, strings of eight characters or more that follow a
sensitive word on its line or the next are measured: how many bytes more does
zstandard need for the surrounding text with the string in its place than without,
when it is primed with a dictionary of common identifiers?  A string is reported as
``novel`` if it takes about as many bytes as random strings of its length and kinds
of characters do in its place, or a byte a character (:meth:`Scanner.is_novel`); names,
words and repeats of what stands around it compress and are not.

Spans count code points, ends exclusive, and are ordered by start, then kind.
``novel`` spans never overlap base spans.  A null or empty text has no span; texts
are read whole; each row is judged by itself.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.common import batches, make_room, slim_batches, texts_of

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MARKS = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))

#: Words after which a string may be a secret, and identifiers that source text is full of.
SENSITIVE = ("password", "passphrase", "passwd", "secret", "token", "apikey", "api key", "private key", "access key", "credential", "authorization", "bearer", "signature", "session id", "client id", "auth key")
IDENTIFIERS = b"""access_token account_id admin algorithm api_key application argument array assert async authorization await base64 bearer boolean
branch buffer callback certificate class client_id client_secret commit config connection const content context cookie count credentials database
default define description development directory document element encoding encrypted endpoint environment error example export false fetch filename
final float function github header hostname identifier import index input instance integer interface internal iterator json key kubernetes lambda
length library localhost login long message method module namespace number object option output package parameter password path pattern platform
plugin port prefix private production profile project property protected public query reference region register repository request resource response
return schema secret security select server service session setting signature size source status string struct subnet suffix table target template
testing text thread timeout timestamp token true type undefined update upload url user_id username utf-8 value variable vector version void warning"""

#: Common words and parts of words.
WORDS = b"""about above across after again against already also although always among another around because become before being between both called came certain change
children come could country different does during each early enough every example family father first following found from general given good government great group have
head hear help here high himself home house however important inside into just keep kind know large last learn least leave life light like little living long look made make
many means might more mother most move much must name near need never next night often only open order other over part people perhaps place point possible present problem
question rather right same school second should side since small social some something still story study system take than that their them then there these they thing think
this those though three through time together tonight toward under until upon very want water weather were what when where which while white whole whose will with within
without woman word work world would write year young able ation ative ement ence ential ership fully graph ible ical ification ility ingly ionally ious ition ization izing
less ment ness ology ously pre sion tation ther tional tionally tions tive ture ward wise inter intern super trans under anti auto counter micro multi over post semi """

_SENSITIVE_BYTES = tuple(w.encode() for w in SENSITIVE)
_CONTEXT = re.compile("(?ai:" + "|".join(re.escape(w).replace(r"\ ", "[ _-]?") for w in SENSITIVE) + ")")
_SENSITIVE_CORES = tuple({w.split(b" ")[-1] if w.split(b" ")[-1] not in (b"key", b"id") else w.split(b" ")[0] for w in _SENSITIVE_BYTES})
_STRING = re.compile(r"[A-Za-z0-9+/_=~-]{8,}")

#: Stands before short surroundings, so that a block has literals enough to be coded by frequency.
FILLER = """We walked along the quiet river until evening, when a just few boats had come home and Jack's lazy fox jumped over his brown dog. Nobody knew why it was so cold;
the weather men from the north gave us no reasons, but our old friends liked to guess: 'Maybe,' they would add, 'winter begins early this year.'
"""
_LETTER = re.compile(r"[A-Za-z]")


#: Strings beyond this length are not compared with random ones, but with their own length.
LONG = 256


def least_bytes(word: str) -> float:
    """No string is novel that adds fewer bytes: dates and amounts have no letters and add up to 16, words up to 10."""
    return 10.0 if _LETTER.search(word) else 17.0


@lru_cache(4096)
def _chance(kinds: str, length: int) -> tuple[str, ...]:
    rng = random.Random(f"{length} {kinds}")
    return tuple("".join(rng.choices(kinds, k=length)) for _ in range(6))


def chance_strings(word: str) -> tuple[str, ...]:
    """Random strings of the word's length over the kinds of characters that it has; the same ones for all such words."""
    return _chance("".join(k for k in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") if not set(word).isdisjoint(k)) or "+-/=_~", len(word))


class Scanner:
    """Finds spans in texts; holds the primed compressor."""

    def __init__(self, novelty: float = 0.9, reach: int = 80, around: int = 256):
        import zstandard

        primed = zstandard.ZstdCompressionDict(WORDS + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False).compress
        self.novelty, self.reach, self.around = novelty, reach, around

    def base(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """Spans ``(start, kind, end, value start, value end)`` of the fixed patterns."""
        data = text.encode("utf-8", "surrogatepass")
        small = data.lower()
        out = []
        if any(w in small for w in _NAMES):
            out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if b"AKIA" in data:
            out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if b"x" * 24 in data.translate(_HEX_MARKS):
            out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def marginal(self, text: str, start: int, end: int, *others: str) -> list[int]:
        """Bytes that the string, and each of the others in its place, adds to its surroundings when compressed."""
        before, after = text[max(0, start - self.around) : start], text[end : end + self.around]
        before = FILLER[len(before) :] + before
        without, *sizes = (len(self.pack((before + x + after).encode("utf-8", "replace"))) for x in ("", text[start:end], *others))
        return [n - without for n in sizes]

    def is_novel(self, text: str, start: int, end: int) -> bool:
        """Whether the string adds about as many bytes as chance would, or a byte for about every character.

        Of 16 characters and more, ``novelty`` of either is enough.
        """
        word = text[start:end]
        own = self.marginal(text, start, end)[0]
        if own < least_bytes(word):
            return False
        if len(word) >= 16 and own >= (0.7 if len(word) > LONG else self.novelty) * len(word):
            return True
        if len(word) > LONG:
            return False
        own, *chance = self.marginal(text, start, end, *chance_strings(word))
        return own >= (self.novelty if len(word) >= 16 else 1.0) * sum(chance) / len(chance)

    def novel(self, text: str, known: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Novel strings outside of ``known`` spans; each string is measured once, whatever number of sensitive words precede it."""
        small = text.lower()
        if not any(w.decode() in small for w in _SENSITIVE_CORES):
            return []
        taken: list[list[int]] = []  # the known spans' union, in order
        for s, _, e, *_ in known:
            if taken and s <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], e)
            else:
                taken.append([s, e])
        begins = [s for s, _ in taken]
        out, done, find = [], 0, _STRING.search
        for m in _CONTEXT.finditer(text):
            stop, at = m.end() + self.reach, max(m.end(), done)
            # A string that begins before ``stop`` has its first eight characters within this end.
            if at >= stop or (c := find(text, at, stop + 7)) is None:
                continue
            line_end = text.find("\n", m.end(), stop)
            line_end = text.find("\n", line_end + 1, stop) if line_end >= 0 else line_end  # the next line too
            stop = stop if line_end < 0 else line_end
            while c is not None and c.start() < stop:
                c = _STRING.match(text, c.start())
                at = done = c.end()
                near = bisect_right(begins, c.end() - 1) - 1
                if (near < 0 or taken[near][1] <= c.start()) and self.is_novel(text, c.start(), c.end()):
                    out.append((c.start(), 3, c.end(), c.start(), c.end()))
                c = find(text, at, stop + 7)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, int, int]]:
        known = self.base(text)
        return sorted(known + self.novel(text, known))

    def redacted(self, text: str, mark: str) -> str:
        """The text with the values of all spans (overlapping ones as one) replaced, until it has none.

        A string may be novel only when what it repeats is gone, so the result is scanned again.
        """
        while found := self.spans(text):
            out, at = [], 0
            for start, end in sorted((x[3], x[4]) for x in found):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            now = "".join([*out, text[at:]])
            if now == text or self.spans(mark):
                return now
            text = now
        return text


def find_secrets(df: DataFrame, text: str = "text", name: str = "secrets", **options) -> DataFrame:
    """Adds ``name``: array of structs kind, start, end; a column of this name is carried as ``<name>_in``."""
    df, text = make_room(df, [name], text)
    slim_batches(df.sparkSession)
    at = df.columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(**options)
        for batch in batches(rows):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e, *_ in scan.spans(t)] for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[redacted]", **options) -> DataFrame:
    """The same rows and columns; in ``text`` each secret's value is replaced by ``mark``. Null stays null."""
    slim_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(**options)
        for batch in batches(rows):
            texts = pa.array([None if t is None else scan.redacted(t, mark) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def secret_digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: key, counts of base spans by kind, ``base_sha256`` and ``spans`` (``kind:start:end``, comma-joined)."""
    slim_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(**options)
        for batch in batches(rows):
            found = [scan.spans(t) for t in texts_of(batch.column(1))]
            said = [[(k, f"{KINDS[k]}:{s}:{e}") for s, k, e, *_ in spans] for spans in found]
            counts = [pa.array([sum(k == kind for k, _ in x) for x in said], pa.int64()) for kind in range(3)]
            base = [hashlib.sha256(",".join(w for k, w in x if k < 3).encode()).hexdigest() for x in said]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([",".join(w for _, w in x) for x in said], pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
