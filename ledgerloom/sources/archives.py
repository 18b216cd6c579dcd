"""Filing archives: listing, choosing one file a receipt, reading members, XML and XBRL to text and facts."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_MEMBER, LEAST_TEXT = 500, 100


def file_type(path: Column) -> Column:
    """Kind by the name's ending; a double ending counts as the archive it is."""
    p = F.lower(path)
    return F.when(p.endswith(".zip.pdf"), "zip.pdf").when(p.endswith(".zip"), "zip").when(p.endswith(".pdf"), "pdf").when(p.endswith(".xml"), "xml").when(p.rlike(r"\.html?$"), "html").when(p.rlike(r"\.xlsx?$"), "sheet").when(p.rlike(r"\.(png|jpe?g|tiff?)$"), "image")


def name_parts(path: Column) -> dict[str, Column]:
    """Receipt number and company in a file name like ``company_20240101000123.zip``."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"receipt": F.nullif(F.regexp_extract(name, r"([0-9]{14})", 1), F.lit("")), "company": F.nullif(F.regexp_extract(name, r"^(?:\[[^\]]*\])?([^_\[\]]+)_", 1), F.lit(""))}


def archives(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Archive files under a folder: path, kind, receipt, company, length, and content if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = name_parts(F.col("path"))
    columns = ["path", file_type(F.col("path")).alias("kind"), parts["receipt"].alias("receipt"), parts["company"].alias("company"), "length"]
    return files.filter(file_type(F.col("path")).isin("zip", "zip.pdf")).select(*columns, *(["content"] if with_content else []))


def one_per_receipt(files: DataFrame) -> DataFrame:
    """One file a receipt, plain zips first, then by path; files without a receipt are left out."""
    w = Window.partitionBy("receipt").orderBy(F.when(F.col("kind") == "zip", 0).otherwise(1), "path")
    return files.filter("receipt is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def decoded(raw: bytes) -> str:
    """Text by XML declaration, byte order mark, UTF-8, Korean code page, Latin-1."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    declared = re.match(rb"""<\?xml[^>]*encoding=["']([A-Za-z0-9_-]+)["']""", raw)
    for name in ([declared[1].decode()] if declared else []) + ["utf-8", "cp949"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def _table_lines(table: ET.Element) -> list[str]:
    rows = (["".join(c.itertext()).strip() for c in row if c.tag.upper() in ("TD", "TH", "TE", "TU")] for row in table.iter() if row.tag.upper() == "TR")
    return ["  ".join(filter(None, cells)) for cells in rows if any(cells)]


def filing_text(raw: bytes) -> str:
    """Structured text of a filing's XML: titles as headings by depth, tables between marks, short lines once.

    A paragraph is one line with all that stands in it, inline marks included. Text that is no XML loses its tags alone.
    """
    try:
        root = ET.fromstring(re.sub(r"<\?xml[^>]*\?>|&(?!#|[a-zA-Z]+;)", lambda m: "" if m[0][0] == "<" else "&amp;", decoded(raw)))
    except ET.ParseError:
        return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]*>", "\n", decoded(raw))).strip()
    lines: list[str] = []

    def walk(node: ET.Element, depth: int) -> None:
        tag = node.tag.upper()
        if tag == "TABLE":
            rows = _table_lines(node)
            if rows:
                lines.extend(["[TABLE]", *rows, "[/TABLE]"])
            return
        if tag in ("TITLE", "COVER-TITLE"):
            text = " ".join("".join(node.itertext()).split())
            if text:
                lines.append(("##" if depth <= 2 else "###") + " " + text)
            return
        if tag in ("P", "SPAN") and not any(n.tag.upper() in ("TABLE", "TITLE", "P") for n in node.iter() if n is not node):
            text = " ".join("".join(node.itertext()).split())
            if text:
                lines.append(text)
            return
        text = " ".join((node.text or "").split())
        if len(text) > 5 or text and tag in ("P", "SPAN"):
            lines.append(text)
        for child in node:
            walk(child, depth + 1)
            tail = " ".join((child.tail or "").split())
            if len(tail) > 5:
                lines.append(tail)

    walk(root, 0)
    seen, out = set(), []
    for line in lines:
        if len(line) < 80 and not line.startswith("["):
            if line in seen:
                continue
            seen.add(line)
        out.append(line)
    return "\n".join(out)


def member_role(name: str) -> tuple[int, str]:
    """Order and role of an archive's member: main, audit, other."""
    stem = name.lower()
    return (1, "audit") if "audit" in stem or stem.endswith(("_00760.xml", "_00761.xml")) else (0, "main") if re.search(r"\d{14}\.xml$", stem) else (2, "other")


def archive_texts(files: DataFrame) -> DataFrame:
    """Members of archives with content: path, receipt, member, role, text, problem.

    Members under 500 bytes and texts under 100 characters are left out. A file or member that can't be read
    gives a row with the problem's name and no text, and stops nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, receipt, content in zip(b["path"], b["receipt"], b["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    names = sorted((n for n in archive.namelist() if n.lower().endswith((".xml", ".html", ".htm"))), key=lambda n: (member_role(n)[0], n))
                except zipfile.BadZipFile:
                    rows.append((path, receipt, None, None, None, "bad_zip"))
                    continue
                found = 0
                for name in names:
                    try:
                        raw = archive.read(name)
                        text = filing_text(raw) if len(raw) >= LEAST_MEMBER else ""
                    except Exception as e:  # noqa: BLE001  one member's damage must not lose the others
                        rows.append((path, receipt, name, member_role(name)[1], None, type(e).__name__))
                        continue
                    if len(text) >= LEAST_TEXT:
                        rows.append((path, receipt, name, member_role(name)[1], text, None))
                        found += 1
                if not found:
                    rows.append((path, receipt, None, None, None, "empty_after_parse"))
            yield pd.DataFrame(rows, columns=["path", "receipt", "member", "role", "text", "problem"])

    return files.select("path", "receipt", "content").mapInPandas(run, "path string, receipt string, member string, role string, text string, problem string")


def xbrl_rows(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(contexts, facts) of an instance: (context id, period, scope) and (element, context id, unit, value)."""
    root = ET.fromstring(decoded(raw))
    local = lambda tag: tag.rpartition("}")[2]
    contexts, facts = [], []
    for node in root:
        if local(node.tag) == "context":
            dates = {local(x.tag): (x.text or "").strip() for x in node.iter()}
            period = dates.get("instant") or "/".join(filter(None, (dates.get("startDate"), dates.get("endDate"))))
            members = " ".join((x.text or "") for x in node.iter() if local(x.tag) == "explicitMember")
            contexts.append((node.get("id"), period, "consolidated" if "Consolidated" in members else "separate" if "Separate" in members else "unknown"))
        elif node.get("contextRef"):
            facts.append((local(node.tag), node.get("contextRef"), node.get("unitRef"), (node.text or "").strip()))
    return contexts, facts


def label_rows(raw: bytes) -> list[tuple[str, str]]:
    """(element, label) of a label linkbase: locators, arcs and labels joined by their names."""
    root = ET.fromstring(decoded(raw))
    local = lambda tag: tag.rpartition("}")[2]
    x = "{http://www.w3.org/1999/xlink}"
    locs = {n.get(x + "label"): (n.get(x + "href") or "").rpartition("#")[2] for n in root.iter() if local(n.tag) == "loc"}
    labels = {n.get(x + "label"): (n.text or "").strip() for n in root.iter() if local(n.tag) == "label"}
    arcs = [(n.get(x + "from"), n.get(x + "to")) for n in root.iter() if local(n.tag) == "labelArc"]
    return [(locs[a], labels[b]) for a, b in arcs if a in locs and labels.get(b)]


def labelled_facts(facts: DataFrame, contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts (element, context, unit, value) with their period, scope and label; the element's name where no label is known."""
    key = F.regexp_replace(F.lower("element"), "^[^_]*_", "")
    names = labels.select(key.alias("k"), "label").groupBy("k").agg(F.min("label").alias("label"))
    return facts.join(contexts, "context", "left").withColumn("k", key).join(names, "k", "left").select("element", F.coalesce("label", "element").alias("label"), "period", "scope", "unit", "value")


def xml_lines(raw: bytes) -> str:
    """Any XML as ``tag: text`` lines in document order; elements without text of their own give none; what is no XML gives nothing."""
    try:
        root = ET.fromstring(re.sub(r"<\?xml[^>]*\?>", "", decoded(raw)))
    except ET.ParseError:
        return ""
    lines = ((n.tag.rpartition("}")[2], " ".join((n.text or "").split())) for n in root.iter())
    return "\n".join(f"{tag}: {text}" for tag, text in lines if text)


def xbrl_nodes(content):
    """Texts of 2 to 200 characters between marks, as a column over decoded content."""
    found = F.transform(F.regexp_extract_all(content, F.lit(r">([^<>]+)<"), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.filter(found, lambda t: F.length(t).between(2, 200))


def read_registry(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(all companies, listed ones by length of name) of a registry's XML with an element ``list`` a company."""
    rows = spark.read.format("xml").option("rowTag", "list").schema("corp_code string, corp_name string, stock_code string").load(path)
    rows = rows.select("corp_code", F.trim("corp_name").alias("corp_name"), F.nullif(F.trim("stock_code"), F.lit("")).alias("stock_code"))
    return rows, rows.filter("stock_code is not null").orderBy(F.length("corp_name"), "corp_name", "corp_code")


def manifest(files: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """Files in order of their tier and path: id, path, tier, rank, status. Files of no tier come last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in tiers.items() for x in pair)), F.col("tier")), F.lit(max(tiers.values(), default=0) + 1))
    return files.select(F.xxhash64("path").alias("id"), "path", "tier", rank.alias("rank"), F.lit("pending").alias("status")).orderBy("rank", "path")


def refilled(documents: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """Documents whose missing or blank text is taken from the file of the same receipt number, whole or its first ``most`` characters; of several files the longest text, then the least."""
    own = texts.groupBy("receipt").agg(F.min_by("text", F.struct(-F.length("text"), F.col("text"))).alias("_new"))
    new = F.col("_new") if most is None else F.substring("_new", 1, most)
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return documents.join(own, "receipt", "left").withColumn("text", F.when(blank, F.coalesce(new, F.col("text"))).otherwise(F.col("text"))).drop("_new")
