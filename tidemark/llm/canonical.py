"""Problem 10: one form for text that looks the same.

DuckDB runs inside each Arrow partition: invisible characters are removed by a regular expression, accents are
composed by nfc_normalize, full-width forms, blanks and look-alike letters are translated, and accents are composed
again over the letters that this gave, in one SQL expression. What is mapped: full-width forms, the space separators of
Unicode, and the Cyrillic and Greek letters below with whatever accents. Ligatures, mathematical letters, half-width
kana and look-alikes of other scripts stay as they are. Letter case, accents, digits, punctuation, tabs and line breaks stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch

#: Cyrillic and Greek letters that look like Latin ones: fixed values.
CYRILLIC = {"а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y"}
GREEK = {"ν": "v", "ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
#: Characters that show nothing: soft hyphen, joiners, direction marks, fillers, variation selectors, tags.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"


def translations() -> tuple[str, str]:
    """Single characters and what they become, by rule from the tables above.

    Full-width forms are their ordinary ones (code point less 0xFEE0, or the compatibility form), every space
    separator is a blank, and a composed Cyrillic or Greek letter whose base looks Latin becomes the composed Latin one.
    """
    like = CYRILLIC | GREEK
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (0xFF5F, 0xFF60, *range(0xFFE0, 0xFFE7)) if c != 0xFFE3} | {"￣": "¯"}
    out |= {chr(c): " " for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"}
    out |= like
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0] in like and len(n := unicodedata.normalize("NFC", like[d[0]] + d[1:])) == 1:
            out[chr(c)] = n
    return "".join(out), "".join(out.values())


def accented() -> dict[str, str]:
    """Composed Cyrillic and Greek letters that look like a Latin one with accents of which Unicode has no composed form."""
    like, out = CYRILLIC | GREEK, {}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0] in like and len(n := unicodedata.normalize("NFC", like[d[0]] + d[1:])) > 1:
            out[chr(c)] = n
    return out


def expression(text: str) -> str:
    """The SQL of the form of a text. Rare letters that become several are replaced one by one, in texts that have any."""
    a, b = (x.replace("'", "''") for x in translations())
    each = x = f"translate(nfc_normalize(regexp_replace({text}, '{INVISIBLE}', '', 'g')), '{a}', '{b}')"
    for c, to in accented().items():
        each = f"replace({each}, '{c}', '{to}')"
    # Composed in the stored text, or by nfc_normalize from a letter and a mark.
    some = f"[{''.join(accented())}]|[{''.join(CYRILLIC)}{''.join(GREEK)}][^\\x{{0}}-\\x{{2FF}}\\x{{370}}-\\x{{FFFFF}}]"
    return f"nfc_normalize(CASE WHEN regexp_matches(regexp_replace({text}, '{INVISIBLE}', '', 'g'), '{some}') THEN {each} ELSE {x} END)"


def forms(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, form and the columns to keep: the consistent form of each text; null stays null, empty stays empty. Applying it twice changes nothing."""
    names = [key, *keep]
    sql = f"SELECT {', '.join(f'k{i}' for i in range(len(names)))}, {expression('t')} AS form FROM part"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch.rename_columns([*(f"k{i}" for i in range(len(names))), "t"])]))
            got = con.sql(sql).to_arrow_table()
            con.unregister("part")
            to = [pa.field(n, batch.schema.field(i).type) for i, n in enumerate(names)]
            yield from got.rename_columns([*names, "form"]).cast(pa.schema([*to, pa.field("form", pa.string())])).combine_chunks().to_batches()

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, text).mapInArrow(run, f"{kinds}, form string")


def classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, form_key, text_key (SHA-256 of form and stored text) of documents that show something."""
    stored = docs.where("text IS NOT NULL").select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("text_key"))
    shown = forms(stored, keep=("text_key",)).where(F.col("form").rlike(r"[^ \t\n\r\x0b\f]"))
    return scratch.cut(shown.select("doc_id", F.unhex(F.sha2("form", 256)).alias("form_key"), "text_key"), "classes")


def found(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_a < doc_b: documents whose stored texts differ but whose forms agree.

    Classes of equal stored texts are paired within a form, not documents, so a text with any number of exact copies
    pairs with other texts only. Null texts, and texts that show nothing, take no part.
    """
    c = classes(docs, scratch)
    texts = c.select("form_key", "text_key").distinct()
    several = texts.groupBy("form_key").count().where("count > 1").select("form_key")
    texts = scratch.cut(texts.join(several, "form_key", "left_semi"), "texts")
    pairs = texts.join(texts.withColumnRenamed("text_key", "other"), "form_key").where("text_key < other").select("text_key", "other")
    a = c.select("text_key", F.col("doc_id").alias("x"))
    b = c.select(F.col("text_key").alias("other"), F.col("doc_id").alias("y"))
    return pairs.join(a, "text_key").join(b, "other").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
