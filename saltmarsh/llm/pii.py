"""Personal data in texts: detection, surrogates of the same type and format, collision checks.

Each entity is replaced by a function of the key and of the entity alone (`surrogates`), so all
its mentions in a corpus get one replacement, however they are spelled. `resolve` checks over
the whole corpus that no two entities share one and that none is its own; the few that do get a
version of the key of their own. The key is an argument everywhere: who has it can tell which
surrogate stands for what, so it is a secret of the run (`session_key`).

Nulls stay null, empty texts empty; rows that repeat an id are treated row by row.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches, checkpoint, of_texts
from saltmarsh.llm.surrogates import GENDER, canonical, labelled, replaceable, surrogate

#: The setting that has a run's key.
SETTING = "spark.saltmarsh.pii.key"
#: Titles by the gender that they show, n if none.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Professor": "n", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mademoiselle": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Srta": "f", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f",
    "г-н": "m", "г-жа": "f", "Г-н": "m", "Г-жа": "f", "κύριος": "m", "κυρία": "f", "Κύριος": "m", "Κυρία": "f",
}

EMAIL = re.compile(r"[A-Za-z0-9À-ɏ](?:[\wÀ-ɏ.%+-]*[\wÀ-ɏ])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
SECRET = re.compile(r"""[=:][ \t]{0,4}["']?([A-Za-z0-9+/_\-]{16,}={0,2})""")
SAYS = re.compile(r"""(?:key|token|secret|passw(?:or)?d|pwd|credential)s?["']?[ \t]{0,4}$""", re.IGNORECASE)
NUMBER = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ .-]?\d)*(?![\w])")
#: Numbers that stand side by side look like one to NUMBER; these are the forms that are told apart then.
APART = re.compile(r"(?<![\d.])(?:\+\d{1,3} ?\(\d{1,5}\) ?\d{3}[ -]\d{4}|\(\d{1,5}\) ?\d{3}[ -]\d{4}|\d{4}(?:[ -]\d{4}){3}|\d{13,19}|\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|\d{3}-\d{2}-\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)")
CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DIGIT = re.compile(r"\d[\d ().-]{5}")
_CAP, _LOW = "A-ZÀ-ÖØ-ÞĀ-ſА-ЯЁІЇЄҐΆ-Ϋ", "a-zß-öø-ÿĀ-ſа-яёіїєґў-џά-ώA-ZÀ-ÖØ-ÞА-ЯЁΆ-Ϋ"
_WORD = f"[{_CAP}][{_LOW}]*(?:[-'’][{_CAP}{_LOW}][{_LOW}]*)*"
_LINK = r"(?:(?:van|von|de|der|den|del|da|di|du|la|le|y) )*"
PERSON = re.compile(rf"(?<![\w-])({'|'.join(sorted(TITLES, key=len, reverse=True))})(\.? )({_WORD})((?: {_LINK}{_WORD}){{0,2}})(?![\w])")
TITLED = tuple(f"{t}{end}" for t in TITLES for end in (" ", ". "))
NAMED = re.compile(rf"(?<![\w-])([{_CAP}][{_LOW}]+) (?={_WORD})")
FAMILY = re.compile(rf"(?: {_LINK}{_WORD}(?![\w])){{1,2}}")
_LINKS = frozenset("van von de der den del da di du la le y".split())


def session_key(spark: SparkSession) -> bytes:
    """The key of a run: what SETTING has, or else a random one that lasts as long as the application."""
    given = spark.conf.get(SETTING, None)
    if given:
        return given.encode()
    return _random.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


_random: dict[str, bytes] = {}


class Key(bytes):
    """A key with versions, by kind and canonical spelling, of the entities that have one of their own; a
    version of -1 stands for a label."""

    versions: dict[tuple[str, str], int] = {}


def substitute(key: bytes, kind: str, text: str) -> str:
    version = key.versions.get((kind, canonical(kind, text))) if isinstance(key, Key) and key.versions else None
    if version == -1:
        return labelled(bytes(key), kind, text)
    return surrogate(bytes(key) if version is None else bytes(key) + b"#%d" % version, kind, text)


# --- detection


def _kind(said: str) -> str | None:
    n = sum(map(str.isdigit, said))
    parts = said.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 and str(int(p)) == p for p in parts):
        return "ip"
    if 10 <= n <= 15 and (said[0] == "+" or "(" in said):
        return "phone"
    if 13 <= n <= 19 and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{3,6}){2,4}", said):
        return "account"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", said):
        return "id"
    return "phone" if re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", said) else None


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in NUMBER.finditer(text):
        kind = _kind(m.group())
        if kind:
            yield m.start(), m.end(), kind
        elif m.end() - m.start() > 8:  # none of the forms is shorter
            for part in APART.finditer(m.group()):
                kind = _kind(part.group())
                if kind:
                    yield m.start() + part.start(), m.start() + part.end(), kind


def _words(start: int, said: str) -> Iterator[tuple[int, int]]:
    """Where the words of a name are, without particles."""
    at = start
    for word in said.split(" "):
        if word and word not in _LINKS:
            yield at, at + len(word)
        at += len(word) + 1


def _titled(text: str) -> Iterator[tuple[int, int, str]]:
    """Names behind a title: the last word of several is the family name, those before it are given names of the
    title's gender (or of that which the name itself shows); a single word is a given name if it is one of the pool."""
    for m in PERSON.finditer(text):
        shown = TITLES[m.group(1)]
        words = [(m.start(3), m.end(3)), *_words(m.start(4), m.group(4))]
        known = GENDER.get(text[m.start(3) : m.end(3)].lower())
        gender = shown if shown != "n" else known or "n"
        if len(words) == 1:
            yield (*words[0], gender if known and known == gender else "family")
            continue
        for a, b in words[:-1]:
            yield a, b, gender
        yield (*words[-1], "family")


def _pooled(text: str) -> Iterator[tuple[int, int, str]]:
    """Given names of the pools that a name follows."""
    for m in NAMED.finditer(text):
        gender = GENDER.get(m.group(1).lower())
        if gender and (family := FAMILY.match(text, m.end(1))):
            words = list(_words(family.start(), family.group()))
            yield m.start(1), m.end(1), gender
            for a, b in words[:-1]:
                yield a, b, gender
            yield (*words[-1], "family")


def _again(text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Later and earlier mentions of the names that were found in a text, as they were written there."""
    roles: dict[str, str] = {}
    for a, b, role in sorted(found):
        if b - a > 1:
            roles.setdefault(text[a:b], role)
    if roles:
        for m in re.finditer(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(roles, key=len, reverse=True)))})(?![\w-])", text):
            yield m.start(), m.end(), roles[m.group()]


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in a text, in order, without overlaps; where two overlap the
    one found by the earlier rule stays: e-mail, secret, bank code, number, person."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        secret = [m.span(1) for m in SECRET.finditer(text) if SAYS.search(text, max(0, m.start() - 24), m.start())]
        found += [(a, b, _kind(text[a:b]) or "secret") for a, b in secret]  # a number is one entity whatever stands before it
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "iban") for m in CODE.finditer(text)]
        rest = text
        if found:  # else a number that stands beside one of these runs into it
            hidden = list(text)
            for start, end, _ in found:
                hidden[start:end] = "\0" * (end - start)
            rest = "".join(hidden)
        found += _numbers(rest)
    names = list(_titled(text)) if any(t in text for t in TITLED) else []
    names += _pooled(text)
    if names:
        found += names
        found += _again(text, names)
    kept: list[tuple[int, int, str]] = []
    taken: set[int] = set()
    for a, b, kind in found:
        if not (a in taken or b - 1 in taken or any(i in taken for i in range(a, b))) and replaceable(kind, text[a:b]):
            kept.append((a, b, kind))
            taken.update(range(a, b))
    return sorted(kept)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with all entities replaced, and (kind, original, surrogate) of each; null stays null."""
    spans = detect(text)
    if not spans:
        return text, []
    parts, at, said = [], 0, []
    for a, b, kind in spans:
        new = substitute(key, kind, text[a:b])
        parts += [text[at:a], new]
        said.append((kind, text[a:b], new))
        at = b
    return "".join(parts) + text[at:], said


# --- over a corpus

_STRINGS = lambda names, rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(len(names))], names)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """docs (text, ...) -> (kind, original, surrogate), a row for each mention."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield _STRINGS(["kind", "original", "surrogate"], [x for t in batch.column("text").to_pylist() for x in replace(t, key)[1]])

    return docs.select("text").mapInArrow(run, "kind string, original string, surrogate string")


def mentioned(docs: DataFrame) -> DataFrame:
    """docs (text, ...) -> (kind, original), the entities in their canonical spelling, distinct."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield _STRINGS(["kind", "original"], sorted({(k, canonical(k, t[a:b])) for t in batch.column("text").to_pylist() for a, b, k in detect(t)}))

    return docs.select("text").mapInArrow(run, "kind string, original string").distinct()


def replaced(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, original) -> (kind, original, surrogate), all in the canonical spelling."""

    def run(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = zip(batch.column("kind").to_pylist(), batch.column("original").to_pylist())
            yield _STRINGS(["kind", "original", "surrogate"], [(k, old, canonical(k, substitute(key, k, old))) for k, old in rows])

    return found.mapInArrow(run, "kind string, original string, surrogate string")


def clashes(said: DataFrame) -> DataFrame:
    """(kind, original, surrogate) -> (surrogate, originals, least, same): surrogates that stand for more than one
    original, of whatever kind, or for themselves; `least` is the one that may keep it."""
    named = F.concat_ws("|", "kind", "original")
    return said.groupBy("surrogate").agg(F.count("*").alias("originals"), F.min(named).alias("least"), F.max(F.col("original") == F.col("surrogate")).alias("same")).filter("originals > 1 or same")


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(surrogate, originals): surrogates in docs that stand for more than one original, or for none but itself.
    Spellings of one number or address with other cases or punctuation count as one."""
    return clashes(replaced(mentioned(docs), key)).select("surrogate", "originals")


def resolve(docs: DataFrame, key: bytes, tries: int = 16) -> bytes:
    """The key without a collision in docs: of the originals that share a surrogate all but one, and those that
    are their own, get a version of it, until none is left; what still collides after `tries` versions gets a
    label. Docs are read once. Only the entities concerned come to the driver and travel with the key: within a
    kind and format there are none, as these are permuted, so there are as many as different formats produce
    by chance."""
    known = checkpoint(mentioned(docs))
    found = Key(key)
    for turn in range(tries + 1):
        said = replaced(known, found)
        named = F.concat_ws("|", "kind", "original")
        concerned = said.join(clashes(said).select("surrogate", "least"), "surrogate").filter((named != F.col("least")) | (F.col("original") == F.col("surrogate"))).select("kind", "original").collect()
        if not concerned:
            break
        versions = dict(found.versions)
        for row in concerned:
            versions[row["kind"], row["original"]] = versions.get((row["kind"], row["original"]), 0) + 1 if turn < tries else -1
        found = Key(key)
        found.versions = versions
    return found


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with every text replaced; other columns, n_chars too, stay as they are."""

    run = of_texts(lambda texts: [replace(t, key)[0] for t in texts], "string")
    return docs.select(*(run(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame, key: bytes) -> DataFrame:
    """The result of query op10: doc_id, text with surrogates, n_entities, kinds (sorted, distinct)."""
    key = resolve(docs, key)

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            done = [replace(t, key) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for _, s in done], pa.int32()), pa.array([sorted({x[0] for x in s}) for _, s in done], pa.list_(pa.string()))],
                ["doc_id", "text", "n_entities", "kinds"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_entities int, kinds array<string>")
