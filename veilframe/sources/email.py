"""Mail messages: bytes to chunks and back, with the standard library inside Arrow tasks.

A message is one row and stays one row. Parsing turns its bytes into an array of chunks;
detection and rewriting of the chunks run in the JVM like those of any document; writing
takes the message and its scrubbed chunks in the same row. Nothing is grouped.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterable
from email.headerregistry import HeaderRegistry, UnstructuredHeader
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions.arrays import running_sum, var

# The last two are our own addition: they hold addresses as well.
HEADERS = ("From", "To", "Cc", "Subject", "Reply-To", "Bcc")
BODY_TYPES = ("text/plain", "text/html")
#: Headers that a task keeps after reading them, and the longest of these.
KEPT_HEADERS, KEPT_LENGTH = 1024, 1000
MAIL_FIELDS = [
    T.StructField("error", T.StringType()),
    T.StructField("attachments", T.IntegerType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("ord", T.IntegerType()),
        T.StructField("part", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
]


class _Registry(HeaderRegistry):
    """Makes each header class once and keeps the last headers read.

    The library makes a class for each header it reads, several times a message, and classes
    are freed only by full garbage collections. Header objects are never changed.
    """

    def __init__(self):
        super().__init__()
        self._classes: dict[type, type] = {}
        self._made = lru_cache(maxsize=KEPT_HEADERS)(super().__call__)

    def __getitem__(self, name):
        kind = self.registry.get(name.lower(), self.default_class)
        if kind not in self._classes:
            self._classes[kind] = super().__getitem__(name)
        return self._classes[kind]

    def __call__(self, name, value):
        return self._made(name, value) if len(value) <= KEPT_LENGTH else super().__call__(name, value)


@cache
def _policy():
    """Address headers as plain text: a label is no address and would be dropped."""
    registry = _Registry()
    for name in HEADERS:
        registry.map_to_type(name.lower(), UnstructuredHeader)
    return email.policy.default.clone(header_factory=registry)


def _bodies(message):
    """Text parts in order with their texts; attachments are left out.

    A part in a character set that is unknown, or that its bytes do not fit, is read as
    UTF-8 with U+FFFD for what cannot be read, so that it is scrubbed like any other.
    """
    for part in message.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        if part.get_content_type() in BODY_TYPES:
            try:
                text = part.get_content()
            except (LookupError, KeyError, ValueError):
                text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
            yield part, text


def _parse(content: bytes) -> dict:
    """Chunks of a message; a message that cannot be read gives its error class instead."""
    try:
        return {"error": None, **_chunks(content)}
    except Exception as exc:  # noqa: BLE001 - one bad file must not stop the batch
        return {"error": type(exc).__name__, "attachments": 0, "chunks": []}


def _chunks(content: bytes) -> dict:
    message = email.message_from_bytes(content, policy=_policy())
    chunks = []
    for name in HEADERS:
        for k, value in enumerate(message.get_all(name, [])):
            if str(value).strip():
                chunks.append({"part": name.lower() + (f"-#{k}" if k else ""), "content_type": None,
                               "text": str(value).strip()})
    for k, (part, text) in enumerate(_bodies(message)):
        if text and text.strip():
            chunks.append({"part": f"body{k}", "content_type": part.get_content_type(),
                           "text": text})
    attachments = sum(p.get_content_disposition() == "attachment" for p in message.walk())
    return {"attachments": attachments,
            "chunks": [{"ord": i, **c} for i, c in enumerate(chunks)]}


def parse_mails(mails: DataFrame, content: str = "content", parse=_parse) -> DataFrame:
    """Add ``error``, ``attachments`` and ``chunks`` to a table of messages.

    ``parse`` turns the bytes of one file into these three fields.
    """
    def run(batches):
        for pdf in batches:
            parsed = [parse(c) for c in pdf[content]]
            yield pdf.assign(error=[p["error"] for p in parsed],
                             attachments=[p["attachments"] for p in parsed],
                             chunks=[p["chunks"] for p in parsed])

    return mails.mapInPandas(run, T.StructType(mails.schema.fields + MAIL_FIELDS))


def _write(content: bytes, chunks) -> bytes:
    """The message with new texts. A header keeps its place; one that is repeated, which the
    format does not allow, becomes a single one at the end."""
    message = email.message_from_bytes(content, policy=_policy())
    new = {c["part"]: c["text"] for c in chunks}
    for name in HEADERS:
        parts = [p for p in new if p == name.lower() or p.startswith(f"{name.lower()}-#")]
        value = ", ".join(" ".join(new[p].split()) for p in parts)
        if len(parts) == 1:
            message.replace_header(name, value)
        elif parts:
            del message[name]
            message[name] = value
    for k, (part, _) in enumerate(list(_bodies(message))):
        if f"body{k}" in new:
            part.set_content(new[f"body{k}"], subtype=part.get_content_subtype())
    return message.as_bytes()


def spliced(chunks, parts) -> list[dict]:
    """``chunks`` with the ``parts(ord, start, end, value)`` of each put in; linear in both."""
    own: dict[int, list] = {}
    for p in parts:
        own.setdefault(p["ord"], []).append(p)
    out = []
    for c in chunks:
        text, at, pieces = c["text"], 0, []
        for p in sorted(own.get(c["ord"], ()), key=lambda p: p["start"]):
            pieces += [text[at:p["start"]], p["value"]]
            at = p["end"]
        out.append({**c, "text": "".join([*pieces, text[at:]])})
    return out


def write_mails(mails: DataFrame, content: str, target: str, write=_write) -> DataFrame:
    """Add the file of ``content`` with the ``parts`` of its ``chunks`` replaced.

    A file that cannot be written gets its error class and no output.
    """
    def one(raw, chunks, parts, failed):
        if failed:
            return None, failed
        try:
            return write(raw, spliced(chunks, parts)), None
        except Exception as exc:  # noqa: BLE001 - one bad file must not stop the batch
            return None, type(exc).__name__

    def run(batches):
        for pdf in batches:
            done = [one(*row) for row in zip(pdf[content], pdf["chunks"], pdf["parts"], pdf["error"], strict=True)]
            yield pdf.drop(columns=["chunks", "parts"]).assign(
                **{target: [d[0] for d in done], "error": [d[1] for d in done]})

    kept = [f for f in mails.schema.fields if f.name not in ("chunks", "parts")]
    return mails.mapInPandas(run, T.StructType([*kept, T.StructField(target, T.BinaryType())]))


def mail_chunks(mails: DataFrame, doc: str, content: str = "content") -> DataFrame:
    """One row per header or body chunk with offsets; offsets run over all chunk texts."""
    c = var("c")
    parsed = parse_mails(mails.select(doc, content), content)
    ends = running_sum(f"transform(chunks, {c} -> length({c}.text))")
    return (parsed.select(doc, F.col("attachments").alias("attachment_count"),
                          F.expr(ends).alias("ends"), "chunks")
            .selectExpr(doc, "attachment_count", "ends", "inline(chunks)")
            .select(doc, F.col("ord").alias("chunk_ord"), "part", "content_type",
                    F.expr("get(ends, ord) - length(text)").alias("char_offset_start"),
                    F.expr("get(ends, ord)").alias("char_offset_end"), "text",
                    "attachment_count"))


def hits_of_parsed(parsed: DataFrame, rules: Iterable[R.Rule],
                   threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``hits`` of the parsed ``chunks``."""
    c = var("c")
    plain = f"transform(chunks, {c} -> named_struct('ord', {c}.ord, 'text', {c}.text))"
    return parsed.withColumn("hits", F.expr(L.hits_of_chunks(plain, rules, threshold)))


def scrub_mails(mails: DataFrame, content: str = "content", *,
                rules: Iterable[R.Rule] | None = None,
                threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Redact headers and all text parts.

    Adds ``error``, ``attachments``, ``entity_counts`` as JSON text and
    ``scrubbed_content``, which is NULL for a message with an error.
    """
    rules = R.default_rules() if rules is None else tuple(rules)
    keep = mails.columns
    found = hits_of_parsed(parse_mails(mails, content), rules, threshold)
    found = found.withColumn("parts", F.expr(L.labelled(L.numbered("hits"))))
    counts = f"to_json(map_from_entries({L.entity_counts('hits')}))"
    ready = found.select(*keep, "error", "attachments", F.expr(counts).alias("entity_counts"), "chunks", "parts")
    return write_mails(ready, content, "scrubbed_content")
