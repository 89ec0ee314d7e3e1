"""PII: detected entities get keyed replacements of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.pin import pinned
from larder.llm.batches import keyed, small_batches, tidy

# Words before a secret, and titles with the gender they tell.
SECRET_WORDS = "password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth"
TITLES = {
    "Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Mx.": "", "Dr.": "", "Prof.": "", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "M.": "m", "Sr.": "m", "Sra.": "f", "Señor": "m", "Señora": "f", "г-н": "m", "г-жа": "f", "Господин": "m", "Госпожа": "f",
}
# Syllables of invented names, by script; a vowel that tells the gender ends a given name.
SYLLABLES = {
    "LATIN": (["ba", "do", "fe", "ga", "ki", "lo", "ma", "ni", "pe", "ra", "so", "ti", "va", "zu", "be", "mo"], {"m": "on", "f": "ia", "": "el"}),
    "CYRILLIC": (["ба", "до", "фе", "га", "ки", "ло", "ма", "ни", "пе", "ра", "со", "ти", "ва", "зу", "бе", "мо"], {"m": "он", "f": "ия", "": "ел"}),
    "GREEK": (["βα", "δο", "φε", "γα", "κι", "λο", "μα", "νι", "πε", "ρα", "σο", "τι", "βο", "ζα", "βε", "μο"], {"m": "ος", "f": "ια", "": "ις"}),
}

DIGITS = re.compile(r"\d+")
NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?P<intl>\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?!\w))")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS_KEY = re.compile(r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?)-----END [A-Z ]*PRIVATE KEY-----", re.S)
GIVEN_BY = re.compile(r"[=:]")
BEFORE_SECRET = re.compile(rf"(?<![A-Za-z])(?:{SECRET_WORDS})[\"']?\s{{0,2}}$", re.I)
SECRET = re.compile(r"\s{0,2}[\"']?([A-Za-z0-9+/_.~-]*[A-Za-z0-9])")
TITLED = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(TITLES, key=len, reverse=True))) + r")[  ]+([^\W\d_]+(?:[-'’][^\W\d_]+)*(?:[  ][^\W\d_]+(?:[-'’][^\W\d_]+)*){0,2})")

Entity = tuple[int, int, str, str]  # start, end, type, canonical form


def _luhn(digits: str) -> int:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def entities(text: str) -> list[Entity]:
    """Entities by position; where two overlap, the one that starts first, then the longer one, counts."""
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        local, domain = LOCAL.search(text, max(0, at - 64), at), DOMAIN.match(text, at + 1)
        if local and domain:
            start = local.start() + len(local[0]) - len(local[0].lstrip(".%+-"))
            if start < at:
                found.append((start, domain.end(), "email", text[start : domain.end()].lower()))
        at = text.find("@", at + 1)
    done = 0
    for run in DIGITS.finditer(text):
        start = run.start()
        if start < done:
            continue
        if text[max(0, start - 2) : start].isupper() and (m := IBAN.match(text, max(0, start - 2))):
            value = m[0].replace(" ", "")
            if 15 <= len(value) <= 34 and _mod97(value) == 1:
                found.append((m.start(), m.end(), "iban", value))
                done = m.end()
                continue
        start -= text[start - 1 : start] == "("
        start -= text[start - 1 : start] == "+"
        if not (m := NUMBER.match(text, start)):
            continue
        kind, value = m.lastgroup, m[0]
        digits = re.sub(r"\D", "", value)
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")) or kind == "card" and (_luhn(digits) or not digits.strip("0")):
            continue
        if kind in ("phone", "intl"):
            kind, digits = "phone", digits[-10:] if kind == "phone" else digits
        found.append((m.start(), m.end(), kind, value if kind == "ip" else digits))
        done = m.end()
    for m in GIVEN_BY.finditer(text):
        if BEFORE_SECRET.search(text, max(0, m.start() - 24), m.start()) and (v := SECRET.match(text, m.end())) and len(v[1]) >= 6 and re.search(r"\d", v[1]):
            found.append((v.start(1), v.end(1), "secret", v[1]))
    if "IA" in text:
        found += [(m.start(), m.end(), "access_key", m[0]) for m in ACCESS_KEY.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in PRIVATE_KEY.finditer(text)]
    names: dict[str, str] = {}
    for m in TITLED.finditer(text) if any(title in text for title in TITLES) else ():  # the search for plain text is much faster
        words = list(re.finditer(r"[^  ]+", m[2]))
        words = [w for i, w in enumerate(words) if all(x[0][0].isupper() for x in words[: i + 1])]  # up to the first one in lower case
        gender = TITLES[m[1]]
        for i, w in enumerate(words):
            kind = "surname" if i == len(words) - 1 else f"given_{gender}"
            names.setdefault(w[0], kind)
            found.append((m.start(2) + w.start(), m.start(2) + w.end(), kind, w[0].casefold()))
    for word, kind in names.items():  # the same name without its title
        if len(word) > 2:
            found += [(m.start(), m.end(), kind, word.casefold()) for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text)]
    found.sort(key=lambda e: (e[0], -e[1]))
    kept, done = [], 0
    for e in found:
        if e[0] >= done:
            kept.append(e)
            done = e[1]
    return kept


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    """Endless keyed bytes."""
    block = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{block}".encode(), key=key).digest()
        block += 1


def _digit(stream: Iterator[int], low: int = 0) -> str:
    while (b := next(stream)) >= 250 // (10 - low) * (10 - low):
        pass
    return str(low + b % (10 - low))


def _like(value: str, stream: Iterator[int]) -> str:
    """Every letter and digit by another of its class; hexadecimal text stays hexadecimal."""
    letters = "abcdef" if re.fullmatch(r"[0-9a-fA-F]+", value) else "abcdefghijklmnopqrstuvwxyz"
    pick = lambda c: _digit(stream) if c.isdigit() else letters[next(stream) % len(letters)]
    return "".join(c if not (c.isascii() and c.isalnum()) else pick(c).upper() if c.isupper() else pick(c) for c in value)


def _name(kind: str, value: str, stream: Iterator[int]) -> str:
    script = unicodedata.name(value[0], "LATIN").split()[0]
    parts, ends = SYLLABLES.get(script, SYLLABLES["LATIN"])
    stem = "".join(parts[next(stream) % len(parts)] for _ in range(4 if kind == "surname" else 3))
    return stem + ("" if kind == "surname" else ends[kind.removeprefix("given_")])


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, host_attempt: int = 0) -> str:
    """Canonical form of the replacement. Later attempts are other draws, and from the ninth on longer
    ones where the format has few values, so every value finds one of its own. Addresses of a full
    private block move to the largest private block, and from the thirteenth attempt on to any.
    ``host_attempt`` is that of an address's domain."""
    stream = _stream(key, kind, value, attempt)
    more = "".join(_digit(stream) for _ in range(max(0, attempt - 8)))
    if kind == "email":
        local, domain = value.split("@")
        # A domain keeps one replacement in all addresses.
        return f"{_like(local, stream)}{more}@{surrogate(key, 'domain', domain, host_attempt)}"
    if kind == "domain":
        *labels, top = value.split(".")
        host = [_like(x, _stream(key, "domain", x, attempt)) if x != "example" else x for x in labels]
        return ".".join([*host[:-1], host[-1] + more, top])
    if kind == "ip":
        parts = value.split(".")
        if parts[:2] == ["192", "168"] and attempt >= 4:
            parts[0] = "10"
        keep = 0 if attempt >= 12 else 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        return ".".join(parts[:keep] + [str(1 + (next(stream) * 256 + next(stream)) % 254) for _ in parts[keep:]])
    if kind == "phone":
        plain = "".join(_digit(stream, 2 if len(value) == 10 and i in (0, 3) else 0) for i in range(len(value)))
        return (value[: len(value) - 9] + plain[len(value) - 9 :] if len(value) > 10 else plain) + more
    if kind == "ssn":
        return _digit(stream, 1) + "".join(_digit(stream) for _ in range(8))
    if kind == "card":
        body = value[0] + "".join(_digit(stream) for _ in value[1:-1])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "iban":
        body = _like(value[4:], stream)
        return value[:2] + f"{98 - _mod97(value[:2] + '00' + body):02d}" + body
    if kind == "access_key":
        return value[:4] + _like(value[4:], stream)
    if kind == "secret":
        return _like(value, stream) + more
    return _name(kind, value, stream) + ("" if not more else "".join(SYLLABLES["LATIN"][0][int(d)] for d in more))


def fitted(original: str, kind: str, new: str, surplus: int = 0) -> str:
    """The replacement in the format of the text: digits go into its slots, ``surplus`` last ones behind
    them, and names take its case."""
    if kind in ("phone", "card", "ssn"):
        slots, digits = list(original), list(new[: len(new) - surplus])
        for i in range(len(slots) - 1, -1, -1):
            if slots[i].isdigit() and digits:
                slots[i] = digits.pop()
        return "".join(slots) + new[len(new) - surplus :]
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in original)
    if kind.startswith(("given", "surname")):
        return new.upper() if original.isupper() and len(original) > 1 else new.title() if original[0].isupper() else new
    if kind == "email" and original.isupper():
        return new.upper()
    return new


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None, spans: list[Entity] | None = None) -> tuple[str, list[Entity]]:
    """The text with its entities replaced, and what was found."""
    spans = entities(text) if spans is None else spans
    parts, at, attempts = [], 0, attempts or {}
    for start, end, kind, value in spans:
        new = surrogate(key, kind, value, attempts.get((kind, value), 0), attempts.get(("domain", value.rpartition("@")[2]), 0))
        parts += [text[at:start], fitted(text[start:end], kind, new, len(new) - len(value) if kind == "phone" else 0)]
        at = end
    return "".join(parts) + text[at:], spans


def found_entities(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_key``, ``start``, ``end``, ``kind`` and ``value`` of every entity."""
    rows = keyed(docs, id, text)
    type_ = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            owner, spans = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                own = entities(t) if t else []
                owner += [i] * len(own)
                spans += own
            at = pa.array(owner, pa.int64())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*spans)) or [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row_key").take(at), *columns], ["doc_id", "row_key", "start", "end", "kind", "value"])

    return rows.mapInArrow(tidy(run), f"doc_id {type_}, row_key long, start long, end long, kind string, value string")


def with_domains(values: DataFrame) -> DataFrame:
    """``values`` and, as values of the kind ``domain``, the domains of addresses. Domains that stay as they are
    (``example.com``) are left out: their addresses differ before the sign."""
    own = F.struct("kind", "value")
    host = F.substring_index("value", "@", -1)
    both = F.array(own, F.struct(F.lit("domain").alias("kind"), host.alias("value")))
    named = (F.col("kind") == "email") & ~host.rlike(r"^(example\.)+[a-z]+$")
    rest = [c for c in values.columns if c not in ("kind", "value")]
    return values.select(*rest, F.explode(F.when(named, both).otherwise(F.array(own))).alias("one")).select(*rest, "one.*")


def collisions(values: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """``kind``, ``value`` and ``attempt`` of the values whose first replacement can't stay.

    A replacement may be neither a real value of its kind nor that of another value; of several
    values with one replacement the smallest keeps it. All checks are joins and groupings over the
    distinct values; the loop ends when none has to move.
    """
    def draw(batches):
        for batch in batches:
            new = [surrogate(key, k, v, a) for k, v, a in zip(*(batch.column(n).to_pylist() for n in ("kind", "value", "attempt")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "new"])

    now = pinned(values.select("kind", "value").distinct().withColumn("attempt", F.lit(0)).mapInArrow(tidy(draw), "kind string, value string, attempt int, new string"))
    real = now.select("kind", F.col("value").alias("new"), F.lit(True).alias("taken"))
    for _ in range(rounds):
        owners = now.groupBy("kind", "new").agg(F.min("value").alias("owner"))
        judged = now.join(owners, ["kind", "new"]).join(real, ["kind", "new"], "left").withColumn("moves", F.col("taken").isNotNull() | (F.col("owner") != F.col("value")))
        judged = pinned(judged.select("kind", "value", "attempt", "new", "moves"))
        if judged.filter("moves").isEmpty():
            return now.filter("attempt > 0").select("kind", "value", "attempt")
        moved = judged.filter("moves").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(tidy(draw), "kind string, value string, attempt int, new string")
        now = pinned(judged.filter("not moves").drop("moves").unionByName(moved))
    raise RuntimeError(f"replacements still collide after {rounds} rounds")


def anonymized(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, in its own columns and order of columns, and
    ``count`` (None: left out), the number of entities.

    The same value has the same replacement in every document under the same ``key`` (coreference),
    two values of a kind never share one, and no replacement is a real value of its kind
    (distinctness); both hold for the domains of addresses as well. Replacements are computed from the key alone; only the few values whose first draw
    collides are looked up. Null and empty texts stay as they are; rows repeated in full, null ids
    and an empty table need nothing special. A column of ``docs`` named as ``count`` is an error.
    """
    if count in docs.columns:
        raise ValueError(f"the input has a column {count}")
    spans = pinned(with_domains(found_entities(docs, id, text).select("doc_id", "row_key", "kind", "value")))
    moved = collisions(spans.select("kind", "value"), key)
    columns, place = docs.columns, docs.columns.index(text)
    inner = docs.select(F.struct("*").alias("__row"))
    any_moved = not moved.isEmpty()
    if any_moved:
        by_doc = spans.select("doc_id", "row_key", "kind", "value").distinct().join(moved, ["kind", "value"]).groupBy("doc_id", "row_key").agg(
            F.collect_list(F.struct("kind", "value", "attempt")).alias("moved"))
        by_doc = pinned(by_doc).select(F.struct("doc_id", "row_key").alias("__of"), F.col("moved").alias("__moved"))
        mark = F.xxhash64(F.col(f"__row.`{id}`").cast("string"), F.lit("|"), F.col(f"__row.`{text}`"))
        inner = inner.join(by_doc, F.col(f"__row.`{id}`").eqNullSafe(F.col("__of.doc_id")) & (mark == F.col("__of.row_key")), "left").select("__row.*", "__moved")
    else:
        inner = small_batches(docs)

    def run(batches):
        for batch in batches:
            arrays = list(batch.columns)
            attempts = [{(m["kind"], m["value"]): m["attempt"] for m in x or []} for x in arrays.pop().to_pylist()] if any_moved else [None] * batch.num_rows
            out = [(None, []) if t is None else replaced(t, key, a) for t, a in zip(arrays[place].to_pylist(), attempts)]
            arrays[place] = pa.array([t for t, _ in out], arrays[place].type)
            names = list(columns)
            if count:
                arrays.append(pa.array([len(s) for _, s in out], pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(arrays, names)

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(docs.schema.fields))
    return inner.mapInArrow(tidy(run), schema.add(count, LongType()) if count else schema)
