"""Mail sources: eml files, mbox files and trees of exported items.

Files are read by Spark's own readers (``binaryFile``), so any store that Spark reads will do;
parsing runs in the executors, one Arrow batch at a time.
"""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECIPIENT = "array<struct<address:string,display_name:string,kind:string>>"
MESSAGE = f"locator string, message_id string, in_reply_to string, refs array<string>, subject string, sent string, sender string, recipients {RECIPIENT}, labels array<string>, plain string, html string, reject string"
FIELDS = "locator message_id in_reply_to refs subject sent sender recipients labels plain html reject".split()
_REJECTED = {"text/calendar": "non_mail_item", "multipart/report": "non_mail_item", "application/pkcs7-mime": "encrypted", "application/x-pkcs7-mime": "encrypted", "multipart/encrypted": "encrypted", "application/pgp-encrypted": "encrypted"}


def decoded(part) -> tuple[str, bool]:
    """The text of a part, and whether too much of it could not be decoded."""
    charset = (part.get_content_charset() or "us-ascii").lower()
    raw = part.get_payload(decode=True) or b""
    try:
        text = raw.decode("cp1252" if charset in ("us-ascii", "iso-8859-1", "latin-1") else charset, errors="replace")
    except LookupError:
        return "", True
    return text.translate(str.maketrans("’‘ʼ\x92", "''''")), bool(text) and text.count("�") / len(text) > 0.05


def addresses(values) -> list[tuple[str, str]]:
    """(name, address) of header values; some exporters set semicolons between recipients."""
    outside = r';(?=(?:[^"]*"[^"]*")*[^"]*$)'  # of quotation marks
    return [(n, a) for n, a in getaddresses([re.sub(outside, ",", v) for v in values]) if n or a]


def parsed(raw: bytes, locator: str) -> dict:
    """One message as a row of MESSAGE."""
    mail = email.message_from_bytes(raw, policy=email.policy.default)
    kinds = {p.get_content_type() for p in mail.walk()}
    reject = next((_REJECTED[k] for k in sorted(kinds) if k in _REJECTED), None)
    bodies = {}
    for kind in ("plain", "html"):
        part = mail.get_body(preferencelist=(kind,)) if reject is None else None
        if part is not None:
            bodies[kind], bad = decoded(part)
            reject = "decode_error" if bad else reject
    if reject is None and not bodies:
        reject = "no_text_body"
    every = lambda key: addresses(map(str, mail.get_all(key, [])))
    to = [{"address": a, "display_name": n, "kind": k.lower()} for k in ("To", "Cc", "Bcc") for n, a in every(k)]
    try:
        sent = parsedate_to_datetime(mail["Date"]).isoformat() if mail["Date"] else None
    except ValueError:
        sent = None
    return {
        "locator": locator,
        "message_id": mail["Message-ID"] and str(mail["Message-ID"]).strip(),
        "in_reply_to": mail["In-Reply-To"] and str(mail["In-Reply-To"]).strip(),
        "refs": str(mail["References"] or "").split(),
        "subject": str(mail["Subject"] or ""),
        "sent": sent,
        "sender": next((a for _, a in every("From")), None),
        "recipients": to,
        "labels": [x.strip() for x in str(mail["X-Gmail-Labels"] or "").split(",") if x.strip()],
        "plain": bodies.get("plain"),
        "html": bodies.get("html"),
        "reject": reject,
    }


def split_mbox(raw: bytes) -> Iterator[bytes]:
    """Messages of an mbox file, in order, without their From lines and with quoted ones
    restored."""
    for part in re.split(rb"(?m)^From [^\n]*\n", raw)[1:]:
        yield re.sub(rb"(?m)^>(?=>*From )", b"", part)


def _rows(split):
    def read(batches):
        for pdf in batches:
            out = [parsed(m, f"{path}#{k}") for path, raw in zip(pdf["path"], pdf["content"], strict=True) for k, m in enumerate(split(bytes(raw)))]
            yield pd.DataFrame(out, columns=FIELDS)

    return read


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.eml").mapInPandas(_rows(lambda raw: [raw]), MESSAGE)


def read_mbox(spark: SparkSession, path: str, glob: str = "*mbox*") -> DataFrame:
    return _files(spark, path, glob).mapInPandas(_rows(split_mbox), MESSAGE)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Items of an exported tree: a folder for each item with headers, recipients and bodies."""
    files = _files(spark, path, "*").withColumn("item", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    text = lambda n: F.max(F.when(F.col("name") == n, F.decode("content", "UTF-8"))).alias(n.replace(".", "_"))
    items = files.groupBy("item").agg(*(text(n) for n in ("OutlookHeaders.txt", "InternetHeaders.txt", "Recipients.txt", "Message.txt", "Message.html")))
    field = lambda c, key: F.nullif(F.regexp_extract(c, rf"(?im)^{key}:[ \t]*(.*)$", 1), F.lit(""))
    entries = F.filter(F.split("Recipients_txt", r"\n\s*\n"), lambda x: F.trim(x) != "")
    to = F.transform(entries, lambda x: F.struct(field(x, "(?:Email|SMTP) address").alias("address"), field(x, "(?:Display name|Recipient display name)").alias("display_name"), F.lower(field(x, "Recipient type")).alias("kind")))
    both = F.concat_ws("\n", "InternetHeaders_txt", "OutlookHeaders_txt")
    return items.where("Message_txt is not null or Message_html is not null or OutlookHeaders_txt is not null").select(
        F.col("item").alias("locator"),
        field(both, "Message-ID").alias("message_id"),
        field(both, "In-Reply-To").alias("in_reply_to"),
        field(both, "Subject").alias("subject"),
        F.coalesce(field(both, "Date"), field(both, "Client submit time")).alias("sent"),
        F.coalesce(to, F.expr(f"cast(array() as {RECIPIENT})")).alias("recipients"),
        F.col("Message_txt").alias("plain"),
        F.col("Message_html").alias("html"),
        F.when(F.col("Message_txt").isNull() & F.col("Message_html").isNull(), "no_text_body").alias("reject"),
    )


def in_folders(locator: Column, folders: tuple[str, ...] = ("Sent Items", "Sent", "Sent Mail")) -> Column:
    """Whether a part of the path is one of the folders, case aside."""
    return F.arrays_overlap(F.split(F.lower(locator), "/"), F.lit([f.lower() for f in folders]))


def owner_sent(messages: DataFrame, owners: list[str]) -> DataFrame:
    """Messages from an owner's address or with the label of sent mail, and no excluded label."""
    from ..functions import lexicons as lex

    sent = F.lower("sender").isin([o.lower() for o in owners]) | F.array_contains(F.transform("labels", F.lower), "sent")
    return messages.where(F.coalesce(sent, F.lit(False)) & ~F.arrays_overlap("labels", F.lit(lex.EXCLUDED_LABELS)))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): lines of a list without blanks and comments, in lower case, once each."""
    lines = spark.read.text(path).select(F.trim("value").alias("term"))
    return lines.where("term <> '' and term not like '#%'").select(F.lower("term").alias("term")).distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def markdown_chains(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, version, text): files with one front-matter title, by date and path; two
    versions at least."""
    files = _files(spark, path, "*.md").select("path", F.decode("content", "UTF-8").alias("text"))
    head = F.regexp_extract("text", r"(?s)\A---\s*\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1), "[\"']", ""))
    rows = files.withColumn("title", field("title")).withColumn("date", field("date")).where("title <> ''")
    order = F.array_sort(F.collect_list(F.struct("date", "path", "text")))
    return rows.groupBy("title").agg(order.alias("v")).where(F.size("v") >= 2).select(F.xxhash64("title").alias("chain_id"), F.posexplode("v").alias("version", "r")).select("chain_id", F.col("version").cast("long").alias("version"), "r.text", "r.path")


def write_table(rows: DataFrame, path: str, partition: str = "source") -> None:
    """Records as Parquet, one folder for each source; a rerun replaces what it writes."""
    rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows.write.mode("overwrite").partitionBy(partition).parquet(path)
