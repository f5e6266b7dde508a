"""CSV and XLSX sinks. Both take bounded exports; large tables go to Parquet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from datetime import date, datetime
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The export's row limit, a cell's most characters, and a link's.
EXPORT_ROWS, CELL, LINK = 20_000, 32_767, 2_000
_FORMULA = r"^[=+\-@\t\r]"


def csv_cell(c: Column, kind: str) -> Column:
    """A cell as RFC 4180 text; strings that a spreadsheet would run as a formula get an apostrophe."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    text = F.coalesce(c.cast("string"), F.lit(""))
    if kind != "string":
        return F.when(text.isin("NaN", "Infinity", "-Infinity"), "").otherwise(text)
    safe = F.when(text.rlike(_FORMULA), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): each row as one CSV line without its end."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{name}`"), kind) for name, kind in df.dtypes]).alias("line"))


def limited(df: DataFrame, order: Sequence[Column], most: int = EXPORT_ROWS) -> tuple[list, bool]:
    """(at most `most` rows in order, whether there were more)."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    return rows[:most], len(rows) > most


def csv_bytes(df: DataFrame, order: Sequence[Column], headers: Sequence[str], most: int = EXPORT_ROWS) -> bytes:
    """A CSV file with a byte order mark and CRLF line ends."""
    rows = csv_lines(df.orderBy(*order).limit(most)).collect()
    return ("﻿" + "".join(f"{line}\r\n" for line in [",".join(headers), *[r["line"] for r in rows]])).encode()


def _name(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(value: str) -> str:
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", value)[:CELL], {'"': "&quot;"})


def xlsx_bytes(sheet: str, headers: Sequence[str], rows: Sequence[Sequence], links: Sequence[str] = ()) -> bytes:
    """A workbook with one sheet: bold header, typed dates and numbers, http(s) hyperlinks in the columns named in links."""
    targets, lines = [], []
    for n, row in enumerate([headers, *rows], 1):
        cells = []
        for i, v in enumerate(row):
            at = f"{_name(i)}{n}"
            if v is None or isinstance(v, float) and v != v:
                continue
            if isinstance(v, (date, datetime)) and n > 1:
                day = v.date() if isinstance(v, datetime) else v
                cells.append(f'<c r="{at}" s="2"><v>{(day - date(1970, 1, 1)).days + 25569}</v></c>')
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            else:
                linked = n > 1 and headers[i] in links and re.match(r"https?://", str(v)) and len(str(v)) <= LINK
                if linked:
                    targets.append((at, str(v)))
                style = 1 if n == 1 else 3 if linked else 0
                cells.append(f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_text(str(v))}</t></is></c>')
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    hyper = "".join(f'<hyperlink ref="{at}" r:id="rId{i}"/>' for i, (at, _) in enumerate(targets, 1))
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{_text(sheet)[:31]}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><fonts count="3"><font/><font><b/></font><font><u/><color rgb="FF0563C1"/></font></fonts>'
        '<fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{office}"><sheetData>{"".join(lines)}</sheetData>{f"<hyperlinks>{hyper}</hyperlinks>" if hyper else ""}</worksheet>',
    }
    if targets:
        files["xl/worksheets/_rels/sheet1.xml.rels"] = f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/hyperlink" Target="{_text(t)}" TargetMode="External"/>' for i, (_, t) in enumerate(targets, 1)) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()


def humanize(c: Column) -> Column:
    """FULLY_FUNDED as Fully funded."""
    low = F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1_000_000))


def join_known(array: Column) -> Column:
    """An enumeration list for reading, without UNKNOWN; null if nothing is left."""
    return F.nullif(F.array_join(F.transform(F.filter(array, lambda x: x != "UNKNOWN"), humanize), ", "), F.lit(""))


def yes_no(flag: Column) -> Column:
    """Yes, No, or null where it is not stated."""
    return F.when(flag, "Yes").when(~flag, "No")


def money_text(amount: Column, currency: Column, period: Column) -> Column:
    return F.when(amount.isNotNull(), F.concat_ws(" ", currency, F.regexp_replace(F.format_number(amount, 2), r"\.00$", ""), period))


def sitemap(*parts: DataFrame) -> DataFrame:
    """(loc, priority) of all parts; each is limited by its caller."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def digest(rows: DataFrame, group: str, line: str, order: Sequence[Column], shown: int = 5) -> DataFrame:
    """(group, text): the first lines of each group and how many more there are."""
    from pyspark.sql import Window

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    g = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= shown, F.struct("_r", F.col(line).alias("t"))))).alias("_l"))
    more = F.when(F.col("_n") > shown, F.concat(F.lit("…and "), (F.col("_n") - shown).cast("string"), F.lit(" more")))
    return g.select(group, F.array_join(F.concat(F.transform("_l", lambda x: x["t"]), F.array_compact(F.array(more))), "\n").alias("text"))


def packed_messages(entries: Column, most: int = 3500) -> Column:
    """Entries joined by blank lines into messages of at most `most` characters, in order; a longer entry stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(a: Column, e: Column) -> Column:
        fits = a["now"].isNull() | (F.length(a["now"]) + 2 + F.length(e) <= most)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))).alias("done"), F.when(fits, F.concat_ws("\n\n", a["now"], e)).otherwise(e).alias("now"))

    return F.aggregate(entries, start, step, lambda a: F.concat(a["done"], F.array_compact(F.array(a["now"]))))
