"""Stored web pages to facts: names, phones, links, quality.

What regular expressions can say is native. Only the tree needs Python: `blocks` turns pages into a table of elements in
one pass, and everything after it is DataFrame work. Pages and scripts are read whole. Null pages give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadmill.functions.names import is_valid_company, is_valid_company_labelled, normalized_name
from leadmill.functions.text import extract_phone, extract_phones, has, let, score_to_rank, text, unescape_entities
from leadmill.functions.urls import host, host_contains_any, resolve_link
from leadmill.operators.scratch import scope, written
from leadmill.operators.scripts import named_texts
from leadmill.operators.windows import dealt, first_per_key, nearest_pair, spread

# Labels of a company's name, and of its phone, in tables and lists.
COMPANY_LABELS = [
    "販売業者", "運営会社", "事業者名", "法人名", "会社名", "商号", "企業名", "提供者", "サービス提供者", "運営者", "発行者", "管理者", "事業者", "販売者",
    "運営事業者", "運営主体", "運営元", "提供会社", "サービス提供会社", "屋号", "開業者", "申込先", "相手方", "事業者等", "運営責任者", "オーナー", "代表者名",
    "施設名", "組織名", "法人名称", "正式名称", "ショップ名", "店舗名", "出店者名", "ストア名", "医療機関名", "診療所名", "法人の名称", "事業所名", "販売会社",
    "代理店", "主催者", "主催会社", "代理店名", "申込先会社", "注文先", "受注者", "取扱業者", "取扱事業者", "サービス提供元", "サービス責任者",
]
PHONE_LABELS = [
    "TEL", "Tel", "tel", "電話", "お電話", "電話番号", "連絡先", "お問い合わせ先", "代表電話", "代表番号", "問い合わせ電話", "お電話番号", "電話（代表）",
    "お電話でのお問い合わせ", "電話番号（代表）", "フリーダイヤル", "電話でのお問い合わせ", "問い合わせ電話番号", "電話受付", "お電話受付", "ご連絡先", "Phone",
    "phone", "PHONE", "Telephone", "telephone", "電話番号・FAX", "電話・FAX", "携帯", "携帯電話", "携帯番号", "直通", "直通電話", "直通番号",
    "返品・交換の連絡先", "問い合わせ電話", "購入・問い合わせ",
]
LEGAL_WORDS = ["特定商取引", "特商法", "tokutei", "tokusho", "legal", "law"]
COMPANY_WORDS = ["会社概要", "会社情報", "企業情報", "運営会社", "company", "about", "corporate", "profile"]
_NAME = "(?:" + "|".join(sorted((x for x in COMPANY_LABELS if x not in ("オーナー", "代表者名")), key=len, reverse=True)) + ")"


class _Tree(HTMLParser):
    """Elements of a page in order: (id, parent, tag, attributes, own and inner text)."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    DROPPED = frozenset(("rt", "rp"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.skip += 1
            return
        if tag == "br":
            self.handle_data("\n")
            return
        k = len(self.rows)
        self.rows.append((k, self.stack[-1] if self.stack else None, tag, list({a: v or "" for a, v in attrs}.items()) if attrs else [], []))
        if tag not in self.VOID:
            self.stack.append(k)

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[i]][2] == tag:
                del self.stack[i:]
                return

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def handle_data(self, data):
        if self.skip or not self.stack:
            return
        raw = self.rows[self.stack[-1]][2] in ("script", "style")
        for k in self.stack[-1:] if raw else self.stack:
            self.rows[k][4].append(data)


_WHOLE = frozenset(("html", "body", "head"))
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32())


def _squeezed(said: str) -> str:
    """The lines of a text that aren't empty, spaces squeezed."""
    if "\n" not in said:
        return " ".join(said.split())
    return "\n".join(x for x in (" ".join(s.split()) for s in said.split("\n")) if x)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=["page_id", "block_id", "parent_id", "tag", "attrs", "text", "pos"])


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html is None:
                continue
            t = _Tree()
            t.feed(html)
            t.close()
            for k, parent, tag, attrs, told in t.rows:
                # ancestors' texts hold their descendants': those of whole-page elements are left out
                said = "" if tag in _WHOLE else _squeezed("".join(told))
                rows.append((page_id, k, parent, tag, attrs, said, k))
                size += 100 + len(said)
            if size > 8_000_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_id, parent_id, tag, attrs, text, pos) of every element; readings of ruby are left out."""
    return spread(pages.select("page_id", "html"), "page_id").mapInArrow(_tree, "page_id long, block_id int, parent_id int, tag string, attrs map<string, string>, text string, pos int")


def visible_text(c: Column) -> Column:
    """Text without scripts, styles and tags, spaces squeezed."""
    t = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = unescape_entities(F.regexp_replace(t, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def _meta(html: Column, name: str) -> Column:
    a = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, rf"(?is)<meta[^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*(?:property|name)\s*=\s*[\"']{name}[\"']", 1)
    return unescape_entities(F.when(a != "", a).otherwise(b))


def _inner(html: Column, tag: str) -> Column:
    return visible_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def headline(html: Column) -> Column:
    """h1 (cut to 80), og:title, title (their first part), og:description; of 2 to 80 characters."""
    h = text(html)
    h1 = _inner(h, "h1")
    part = lambda c: F.trim(F.get(F.split(c, r"\||｜| - |–|—"), F.lit(0)))
    good = lambda c: F.when(F.length(c).between(2, 80), c)
    return F.coalesce(F.when(F.length(h1) > 80, F.rtrim(F.left(h1, F.lit(80)))), good(h1), good(part(_meta(h, "og:title"))), good(part(_inner(h, "title"))), good(F.trim(_meta(h, "og:description"))))


def company_from_text(c: Column) -> Column:
    """A labelled company in plain text: strictly valid ones first, then labelled ones; a copyright line must be strict."""
    value = r"\s*[：:]\s*([^\n：:]{2,80})"
    labelled = F.concat(F.regexp_extract_all(text(c), F.lit(_NAME + value), F.lit(1)), F.regexp_extract_all(text(c), F.lit(_NAME + r"\s*[：:]?\s*\n\s*([^\n：:]{2,80})"), F.lit(1)))
    names = F.transform(labelled, lambda x: F.trim(x))
    rights = F.transform(F.regexp_extract_all(text(c), F.lit(r"(?m)(?:Copyright|©)\s*(?:\(C\)\s*)?(?:\d{4}[年\-\s]*){0,2}([^\n,，.]{4,50}?)(?:\s+All\s+Rights|\s*$)"), F.lit(1)), lambda x: F.trim(x))
    first = lambda xs, ok: F.get(F.filter(xs, ok), F.lit(0))
    return F.coalesce(first(names, is_valid_company), first(names, is_valid_company_labelled), first(rights, is_valid_company))


_TYPES = ["Organization", "Corporation", "LocalBusiness", "ProfessionalService", "Store", "MedicalBusiness", "LegalService", "RealEstateAgent"]


def _variants(pages: DataFrame) -> DataFrame:
    """(page_id, pos, v): objects of the page's JSON-LD scripts; lists and @graph are unrolled."""
    bodies = spread(pages.select("page_id", "html"), "page_id").select("page_id", F.posexplode(F.regexp_extract_all(text(F.col("html")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("pos", "body"))
    v = bodies.select("page_id", "pos", F.try_parse_json("body").alias("v")).filter("v is not null")
    top = v.select("page_id", "pos", F.explode(F.coalesce(F.expr("try_cast(v as array<variant>)"), F.array("v"))).alias("v"))
    first = top.select("page_id", "pos", F.explode(F.concat(F.array("v"), F.coalesce(F.expr("try_cast(try_variant_get(v, '$[\"@graph\"]') as array<variant>)"), F.expr("cast(array() as array<variant>)")))).alias("v"))
    nested = F.array(*[F.expr(f"try_variant_get(v, '$.{k}')") for k in ("parentOrganization", "publisher", "provider", "author")])
    return first.select("page_id", "pos", F.explode(F.concat(F.array("v"), F.filter(nested, lambda x: x.isNotNull()))).alias("v"))


def _list(path: str) -> Column:
    """A field that is a scalar or a list, as an array of texts."""
    return F.coalesce(F.expr(f"try_cast(try_variant_get(v, '{path}') as array<string>)"), F.array(F.expr(f"try_variant_get(v, '{path}', 'string')")))


def jsonld_orgs(pages: DataFrame) -> DataFrame:
    """(page_id, company, phone, pos) of organisations in JSON-LD: the first valid name and phone of each object."""
    v = _variants(pages).withColumn("types", _list('$["@type"]')).filter(F.exists("types", lambda t: F.coalesce(t.isin(_TYPES) | F.rlike(t, F.lit("Organization|Business|Clinic|Store|Service|Corporation")), F.lit(False))))
    phones = F.concat(_list("$.telephone"), _list("$.contactPoint.telephone"), F.coalesce(F.expr("transform(try_cast(try_variant_get(v, '$.contactPoint') as array<variant>), x -> try_variant_get(x, '$.telephone', 'string'))"), F.array().cast("array<string>")))
    names = F.filter(F.concat(_list("$.legalName"), _list("$.name")), lambda x: x.isNotNull())
    company = F.coalesce(F.get(F.filter(names, is_valid_company), F.lit(0)), F.get(F.filter(names, is_valid_company_labelled), F.lit(0)))
    phone = F.get(F.filter(F.transform(F.filter(phones, lambda x: x.isNotNull()), lambda x: extract_phone(x)), lambda x: x.isNotNull()), F.lit(0))
    return v.select("page_id", company.alias("company"), phone.alias("phone"), "pos").filter("company is not null or phone is not null")


def site_names(pages: DataFrame) -> DataFrame:
    """(page_id, company, pos): valid parts of site-name meta tags."""
    tags = F.array(*[F.struct(F.lit(i).alias("i"), _meta(text(F.col("html")), n).alias("c")) for i, n in enumerate(("og:site_name", "application-name", "author", "copyright", "publisher"))])
    each = spread(pages.select("page_id", "html"), "page_id").select("page_id", F.explode(tags).alias("t")).select("page_id", F.col("t.i").alias("i"), F.posexplode(F.split("t.c", r"\s*[|｜/／:：–—]\s*|\s+-\s+")).alias("j", "company"))
    strict = is_valid_company(F.col("company"))
    return each.withColumn("company", F.trim("company")).filter(strict | is_valid_company_labelled(F.col("company"))).select("page_id", "company", (F.col("i") * 100 + F.col("j") + F.when(strict, 0).otherwise(1000)).alias("pos"))


def _cells(b: DataFrame, labels: list[str], out: str) -> DataFrame:
    """(page_id, label_id, parent_id, out, pos): text of the cell after a label's cell in the same row or list; after a
    label alone in its row, the first cell of the next row."""
    row = F.col("tag") == "tr"
    # a row goes with its cells: first for what comes next beside or below, then for the row's own text
    both = dealt(b.filter(F.col("tag").isin("th", "td", "dt", "dd", "tr")).select("page_id", "block_id", "parent_id", row.alias("_is_row"), "text", "pos"), "page_id")
    both = both.withColumn("next", F.lead("text").over(W.partitionBy("page_id", "parent_id", "_is_row").orderBy("pos")))
    w = W.partitionBy("page_id", F.when(F.col("_is_row"), F.col("block_id")).otherwise(F.col("parent_id")))
    of_row = lambda c: F.max(F.when(F.col("_is_row"), F.col(c))).over(w)
    cell = both.withColumns({"_row": of_row("text"), "below": of_row("next")}).filter("not _is_row")
    label = F.regexp_replace(F.col("text"), r"(?U)[\s：:]", "")
    value = F.coalesce("next", F.when(F.col("_row") == F.col("text"), F.col("below")))
    return cell.filter(label.isin(labels)).select("page_id", F.col("block_id").alias("label_id"), "parent_id", F.trim(value).alias(out), "pos").filter(f"coalesce({out}, '') <> ''")


def table_pairs(b: DataFrame) -> DataFrame:
    """(page_id, company, parent_id, pos): values beside company labels in tables and definition lists."""
    company = F.get(F.split("company", "\n"), F.lit(0))
    return _cells(b, COMPANY_LABELS, "company").select("page_id", _worked_out(_labelled(company)).alias("company"), "parent_id", "pos")


def _labelled(c: Column) -> Column:
    """The name, worked out once, where it is valid after a label."""
    return let(c, lambda x: F.when(is_valid_company_labelled(x), x))


def div_pairs(b: DataFrame) -> DataFrame:
    """(page_id, company, parent_id, pos): `label: value` within a block, or label and value in neighbours; not in links."""
    link = F.col("tag") == "a"
    # a link goes with the blocks in it
    own = dealt(b.filter(F.col("tag").isin("div", "p", "span", "li", "section", "a")).select("page_id", F.when(link, F.col("block_id")).otherwise(F.col("parent_id")).alias("parent_id"), link.alias("_link"), "text", "pos"), "page_id")
    w = W.partitionBy("page_id", "parent_id").orderBy("pos")
    own = own.withColumns({"_next": F.lead("text").over(w), "_in_link": F.max("_link").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}).filter("not _in_link")
    inline = F.trim(F.regexp_extract("text", rf"^{_NAME}\s*[：:]\s*([^\n：:]{{2,80}})$", 1))
    near = F.when(F.regexp_replace("text", r"(?U)[\s：:]", "").isin(COMPANY_LABELS), F.trim("_next"))
    said = F.filter(F.array(let(inline, lambda x: F.when(x != "", x)), near), lambda x: F.coalesce(is_valid_company_labelled(x), F.lit(False)))
    both = own.select("page_id", F.explode(said).alias("company"), "parent_id", "pos")
    return first_per_key(both, ["page_id", "company"], "pos").select("page_id", "company", "parent_id", "pos")


def _worked_out(c: Column) -> Column:
    """Each row with the value, once, and no row where it is null: a filter on it would work it out again, before rows are
    dealt."""
    return F.explode(F.filter(F.array(c), lambda x: x.isNotNull()))


def container_phones(b: DataFrame) -> DataFrame:
    """(page_id, block_id, phone, tier): tel links, labelled cells, then phones in the text of containers. Elements are
    written once, as they are read three times."""
    with scope(b.sparkSession) as keep:
        b = written(b, "blocks")
        box = F.col("tag").isin("table", "dl", "section", "article", "footer", "main", "div", "p", "li", "td", "dd", "address")
        tel = b.filter("tag = 'a' and lower(attrs['href']) like 'tel:%'").select("page_id", F.col("parent_id").alias("block_id"), _worked_out(extract_phone(F.col("attrs")["href"])).alias("phone"), F.lit(0).alias("tier"), "pos")
        cells = _cells(b, PHONE_LABELS, "v").select("page_id", F.col("parent_id").alias("block_id"), _worked_out(extract_phone(F.col("v"))).alias("phone"), F.lit(1).alias("tier"), "pos")
        body = b.filter(box).select("page_id", "block_id", _worked_out(extract_phone(F.col("text"))).alias("phone"), F.lit(2).alias("tier"), "pos")
        return keep(tel.unionByName(cells).unionByName(body), "container-phones")


def container_pairs(b: DataFrame) -> DataFrame:
    """(page_id, company, phone): name and phone in one container: a table or list, then a section, then the smallest div.
    Elements are written once, as they are read three times."""
    tiers = F.when(F.col("tag").isin("table", "dl"), 0).when(F.col("tag").isin("section", "article", "footer", "main"), 1).when(F.col("tag") == "div", 2)
    with scope(b.sparkSession) as keep:
        b = written(b, "blocks")
        box = dealt(b.withColumn("tier", tiers).filter("tier is not null").select("page_id", "tier", "text", F.length("text").alias("size"), "pos"), "page_id")
        names = table_pairs(b).unionByName(div_pairs(b)).select("page_id", "company", F.col("pos").alias("name_pos"))
        hit = box.join(names.hint("merge"), "page_id").filter("contains(text, company)").withColumn("phone", _worked_out(extract_phone(F.col("text"))))
        return keep(first_per_key(hit, "page_id", ["tier", "size", "pos", "name_pos"]).select("page_id", "company", "phone"), "container-pairs")


# Keys of a company's name in page state; keys of objects whose name is a company's.
STATE_KEYS = ["companyName", "legalName", "company_name", "legal_name", "organizationName", "organization_name", "corp_name", "corpName"]
STATE_OBJECTS = ["company", "organization", "corporation", "corporate", "operator", "seller", "publisher"]


def state_names(pages: DataFrame, depth: int | None = 8, items: int | None = 30) -> DataFrame:
    """(page_id, raw, script, no, path, at): company names in the objects of scripts, by the keys' names, or `name` of an
    object under a company's key. Objects come before those in them, keys in the order of their names. depth: levels of an
    object that are looked into; items: of a list so many; None: all, as spa_names asks for."""
    with scope(pages.sparkSession) as keep:
        return keep(named_texts(pages, STATE_KEYS, STATE_OBJECTS, depth, items), "state-names")


def spa_names(pages: DataFrame) -> DataFrame:
    """(page_id, company, pos): valid names in the objects of scripts, at any depth and place, then those that stand beside a company's key in any
    script, each once; names are normalised first."""
    scripts = F.regexp_extract_all(text(F.col("html")), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    found = F.flatten(F.transform(scripts, lambda x: F.regexp_extract_all(x, F.lit(r"[\"']?(?:companyName|company_name|corporateName|corporationName|legalName|operatorName|company|corp_name|organizationName)[\"']?\s*[:=]\s*[\"']([^\"'\n]{2,80})[\"']"), F.lit(1))))
    beside = spread(pages.select("page_id", "html"), "page_id").select("page_id", F.posexplode(found).alias("no", "raw")).select("page_id", "raw", F.lit(1).alias("tier"), F.lit(0).alias("script"), "no", F.array().cast("array<int>").alias("path"), F.lit("").alias("at"))
    rows = state_names(pages, depth=None, items=None).withColumn("tier", F.lit(0)).unionByName(beside)
    valid = lambda x: F.when(is_valid_company(x) | is_valid_company_labelled(x), x)
    names = spread(rows.select("raw").distinct(), "raw").select("raw", _worked_out(let(normalized_name(F.col("raw")), valid)).alias("company"))
    each = rows.join(names, "raw")
    once = each.groupBy("page_id", "company").agg(F.min(F.struct("tier", "script", "no", "path", "at")).alias("place"))
    return once.select("page_id", "company", (F.row_number().over(W.partitionBy("page_id").orderBy("place")) - 1).alias("pos"))


def page_company(pages: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(page_id, company, source): the first source that names a valid company: JSON-LD, microdata, script data, meta tags,
    title, headings, elements of a company's class, tables, divs, labels in the text. Elements are written once."""
    with scope(pages.sparkSession) as keep:
        b = written(blocks(pages) if b is None else b, "blocks")
        told = spread(pages.select("page_id", "html"), "page_id")
        html = text(F.col("html"))
        parts = lambda c: F.explode(F.split(c, r"\s*[|｜]\s*|\s+[-–—]\s+"))
        titles = told.select("page_id", parts(_inner(html, "title")).alias("company"), F.lit("title").alias("source"), F.lit(4).alias("tier"), F.lit(0).alias("pos"))
        heads = b.filter("tag in ('h1', 'h2')").select("page_id", F.col("text").alias("company"), F.lit("heading").alias("source"), F.lit(5).alias("tier"), "pos")
        micro = b.filter("attrs['itemprop'] in ('legalName', 'name')").select("page_id", F.coalesce(F.col("attrs")["content"], F.col("text")).alias("company"), F.lit("microdata").alias("source"), F.lit(1).alias("tier"), "pos")
        classes = b.filter(F.rlike(F.lower(F.coalesce(F.col("attrs")["class"], F.lit(""))), F.lit("company|corp|org-name|operator"))).select("page_id", F.col("text").alias("company"), F.lit("class").alias("source"), F.lit(6).alias("tier"), "pos")
        loose = titles.unionByName(heads).unionByName(micro).unionByName(classes).withColumn("company", F.trim("company")).filter(is_valid_company(F.col("company")))
        tagged = lambda d, s, t: d.select("page_id", "company", F.lit(s).alias("source"), F.lit(t).alias("tier"), F.col("pos").cast("int").alias("pos"))
        said = told.select("page_id", _worked_out(company_from_text(visible_text_lines(F.col("html")))).alias("company"), F.lit(0).alias("pos"))
        rows = tagged(jsonld_orgs(pages).filter("company is not null"), "json_ld", 0).unionByName(tagged(spa_names(pages), "spa", 2)).unionByName(tagged(site_names(pages), "meta", 3)).unionByName(loose)
        rows = rows.unionByName(tagged(table_pairs(b), "table", 7)).unionByName(tagged(div_pairs(b), "div", 8)).unionByName(tagged(said, "text", 9))
        return keep(first_per_key(rows, "page_id", ["tier", "pos", "company"]).select("page_id", "company", "source"), "page-company")


def visible_text_lines(c: Column) -> Column:
    """Visible text with a line for each block."""
    t = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|li|tr|td|th|dt|dd|h[1-6]|br|section|article|footer|header|table|ul|ol|dl)\b[^>]*>", "\n")
    t = unescape_entities(F.regexp_replace(t, r"(?s)<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f　]+", " "), r" ?\n[ \n]*", "\n"))


def _phones_of(c: Column) -> Column:
    """What extract_phone gives and then all of extract_phones, which is worked out once."""
    return let(extract_phones(c), lambda found: F.when(has(F.trim(c), r"(?i)^tel:"), F.concat(F.array(extract_phone(c)), found)).otherwise(found))


def page_phones(pages: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(page_id, phone, tier, pos) in order of trust, each phone once: tel links, attributes, address, aria labels, alt
    texts, inputs, data attributes, scripts, meta tags, microdata, classes, labelled cells, text. Elements are written once;
    one reading takes all places of an element, another its cells."""
    a, tag, text_ = F.col("attrs"), F.col("tag"), F.col("text")
    named = F.lower(F.concat_ws(" ", a["class"], a["id"]))
    places = [
        F.when((tag == "a") & F.startswith(F.lower(a["href"]), F.lit("tel:")), a["href"]), F.coalesce(a["data-tel"], a["data-phone"]), F.when(tag == "address", text_), a["aria-label"], F.when(tag == "img", a["alt"]),
        F.when(tag == "input", a["value"]), F.when(F.exists(F.map_keys("attrs"), lambda k: F.startswith(k, F.lit("data-"))), F.array_join(F.map_values("attrs"), "\n")), F.when(tag == "script", text_), F.when(tag == "meta", a["content"]),
        F.when(a["itemprop"] == "telephone", F.coalesce(a["content"], text_)), F.when(F.rlike(named, F.lit("tel|phone|contact")), text_),
    ]
    with scope(pages.sparkSession) as keep:
        b = written(blocks(pages) if b is None else b, "blocks")
        each = F.filter(F.array(*[F.struct(F.lit(i).alias("tier"), c.alias("said")) for i, c in enumerate(places)]), lambda x: x["said"].isNotNull())
        rows = b.select("page_id", "pos", F.explode(each).alias("x")).select("page_id", "pos", "x.tier", F.explode(_phones_of(F.col("x.said"))).alias("phone"))
        cells = _cells(b, PHONE_LABELS, "v").select("page_id", "pos", F.lit(11).alias("tier"), F.explode(extract_phones(F.col("v"))).alias("phone"))
        said = spread(pages.select("page_id", "html"), "page_id").select("page_id", F.lit(12).alias("tier"), F.posexplode(extract_phones(visible_text_lines(F.col("html")))).alias("pos", "phone"))
        out = rows.unionByName(cells).unionByName(said).filter("phone <> ''").select("page_id", "phone", "tier", "pos")
        return keep(first_per_key(out, ["page_id", "phone"], ["tier", "pos"]), "page-phones")


def _lines(pages: DataFrame, body: str = "text") -> DataFrame:
    """(page_id, line, said, company, phone): label and value on one line, or the value on the next."""
    lines = pages.select("page_id", F.posexplode(F.split(text(F.col(body)), "\n")).alias("line", "said")).withColumn("said", F.trim("said")).filter("said <> ''")
    w = W.partitionBy("page_id").orderBy("line")
    after = F.lead("said").over(w)
    one, next_ = F.trim(F.regexp_extract("said", rf"^{_NAME}\s*[：:]\s*(.{{2,80}})$", 1)), has(F.col("said"), rf"^{_NAME}\s*[：:]?$")
    tel = "(?:" + "|".join(sorted(map(lambda x: "\\Q" + x + "\\E", PHONE_LABELS), key=len, reverse=True)) + ")"
    lines = lines.withColumn("_after", after).withColumn("company", F.when(one != "", one).when(next_, F.col("_after")))
    lines = lines.withColumn("company", F.when(is_valid_company_labelled(F.col("company")), F.col("company")))
    labelled = F.when(has(F.col("said"), rf"^{tel}\s*[：:]?$"), extract_phone(F.col("_after"))).when(has(F.col("said"), rf"{tel}\s*[：:\s]"), extract_phone(F.col("said")))
    return lines.withColumn("phone", labelled).drop("_after")


def line_pairs(pages: DataFrame, max_dist: int = 8, below: int = 7) -> DataFrame:
    """(page_id, company, phone, distance) of pages(page_id, text): the nearest labelled lines, else an unlabelled phone in
    the lines below the company, else the company alone."""
    lines = _lines(pages)
    pair = nearest_pair(lines, max_dist, "page_id")
    first = first_per_key(lines.filter("company is not null"), "page_id", "line").select("page_id", F.col("line").alias("_at"), F.col("company").alias("_company"))
    bare = lines.withColumn("_p", extract_phone(F.col("said"))).filter("_p is not null").select("page_id", "line", "_p")
    under = first_per_key(first.join(bare, "page_id").filter(F.col("line").between(F.col("_at") + 1, F.col("_at") + below)), "page_id", "line").select("page_id", "_p", (F.col("line") - F.col("_at")).alias("_d"))
    return first.join(pair, "page_id", "left").join(under, "page_id", "left").select("page_id", F.coalesce("company", "_company").alias("company"), F.coalesce("phone", "_p").alias("phone"), F.coalesce("distance", "_d").alias("distance"))


def legal_block_phone(pages: DataFrame, company: str = "company", max_dist: int = 8) -> DataFrame:
    """(page_id, phone): the phone nearest the company's line in pages(page_id, text, company), within max_dist lines and
    not across the label of another company."""
    lines = _lines(pages).join(pages.select("page_id", F.col(company).alias("_own")), "page_id")
    w = W.partitionBy("page_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("_block", F.sum(F.col("company").isNotNull().cast("int")).over(w)).withColumn("_p", F.coalesce("phone", extract_phone(F.col("said"))))
    own = first_per_key(lines.filter("contains(said, _own)"), "page_id", "line").select("page_id", F.col("line").alias("_at"), F.col("_block").alias("_b"))
    near = lines.filter("_p is not null").join(own, "page_id").withColumn("_d", F.abs(F.col("line") - F.col("_at"))).filter((F.col("_d") <= max_dist) & (F.col("_block") == F.col("_b")))
    return first_per_key(near, "page_id", ["_d", "line"]).select("page_id", F.col("_p").alias("phone"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, said, tag, pos) of every anchor."""
    anchors = F.regexp_extract_all(text(F.col("html")), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    each = pages.select("page_id", "url", F.posexplode(anchors).alias("pos", "tag"))
    href = unescape_entities(F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return each.select("page_id", "url", href.alias("href"), visible_text(F.col("tag")).alias("said"), "tag", "pos")


def keyword_links(pages: DataFrame, words: list[str], limit: int = 5, external: bool = False) -> DataFrame:
    """(page_id, link, pos): links whose text, address or script has one of the words, in order, at most limit a page."""
    words_re = "(?i)" + "|".join("\\Q" + w + "\\E" for w in words)
    hit = links(pages).filter(has(F.col("said"), words_re) | has(F.col("tag"), words_re)).withColumn("link", resolve_link(F.col("url"), F.col("href"), external)).filter("link is not null")
    once = first_per_key(hit, ["page_id", "link"], "pos")
    return once.withColumn("_r", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).filter(F.col("_r") <= limit).select("page_id", "link", "pos")


def page_quality(pages: DataFrame, legal_words: list[str] = LEGAL_WORDS, many: int = 20) -> DataFrame:
    """(page_id, score): 1 for a page that was read, 2 for a legal link, 1 for many distinct internal links."""
    each = links(pages).withColumn("link", resolve_link(F.col("url"), F.col("href")))
    legal = has(F.concat_ws(" ", "said", "href"), "(?i)" + "|".join(legal_words))
    found = each.groupBy("page_id").agg(F.max(legal.cast("int")).alias("_legal"), F.count_distinct("link").alias("_links"))
    read = F.when(text(F.col("html")) != "", 1).otherwise(0)
    return pages.join(found, "page_id", "left").select("page_id", (read + 2 * F.coalesce("_legal", F.lit(0)) + F.when(F.col("_links") >= many, 1).otherwise(0)).alias("score"))


def page_state(c: Column) -> Column:
    """captcha, empty or ok of a stored result page."""
    return F.when(has(c, "(?i)captcha|unusual traffic|通常と異なるトラフィック|ロボットではありません|/sorry/"), "captcha").when(text(c) == "", "empty").otherwise("ok")


def snapshot_flags(pages: DataFrame) -> DataFrame:
    """Flags of stored result pages and the number of results."""
    h = text(F.col("html"))
    return pages.select("page_id", has(h, "(?i)captcha").alias("captcha"), has(h, ">PR<|広告|スポンサー").alias("pr"), has(h, "(?i)rd\\.listing|/aclk|ck\\.").alias("tracking"), has(h, "(?i)ual").alias("ual"), has(h, "広告はありません|no ads").alias("no_ads"), F.regexp_count(h, F.lit("(?i)<h3")).alias("results"))


def merge_site_pages(facts: DataFrame, site: str = "site", order: str = "ord") -> DataFrame:
    """(site, company, phone): a page with both fields wins, else the first of each field."""
    both = F.col("company").isNotNull() & F.col("phone").isNotNull()
    g = facts.groupBy(site).agg(F.min_by(F.when(both, F.struct("company", "phone")), F.when(both, F.col(order))).alias("_b"), F.min_by("company", F.when(F.col("company").isNotNull(), F.col(order))).alias("_c"), F.min_by("phone", F.when(F.col("phone").isNotNull(), F.col(order))).alias("_p"))
    return g.select(site, F.coalesce("_b.company", "_c").alias("company"), F.coalesce("_b.phone", "_p").alias("phone"))


def assemble_companies(leads: DataFrame, facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(lead_id, name, phone, phones, source, corp_number): fields of a lead's pages by tier: legal page, company page,
    landing page, the ad's own name; a contact page's phone comes last. facts(lead_id, kind, company, phone, ord)."""
    from leadmill.operators.match import resolve_exact_or_core

    tier = F.when(F.col("kind") == "legal", 0).when(F.col("kind") == "company", 1).when(F.col("kind") == "landing", 2).when(F.col("kind") == "contact", 4).otherwise(3)
    f = facts.withColumn("tier", tier)
    # one page's name and phone belong together: a page that has both goes before others of its tier
    order = F.struct(F.col("tier"), (F.col("company").isNull() | F.col("phone").isNull()).alias("half"), F.col("ord"))
    name_order, phone_order = F.when(F.col("company").isNotNull() & (F.col("tier") < 4), order), F.when(F.col("phone").isNotNull(), order)
    g = f.groupBy("lead_id").agg(F.min_by("company", name_order).alias("name"), F.min_by("phone", phone_order).alias("phone"), F.min_by("kind", phone_order).alias("source"), F.array_sort(F.collect_set(F.when(F.col("phone").isNotNull(), F.struct("tier", "phone")))).alias("_p"))
    j = leads.select("lead_id", "meta_company").join(g, "lead_id", "left").withColumn("name", F.coalesce("name", F.when(is_valid_company_labelled(F.col("meta_company")), F.col("meta_company"))))
    known = resolve_exact_or_core(j.select("name").filter("name is not null").distinct(), registry).select(F.col("name").alias("_n"), "corp_number", "official_name")
    out = j.join(known, F.col("name") == F.col("_n"), "left")
    return out.select("lead_id", F.coalesce("official_name", "name").alias("name"), "phone", F.coalesce(F.array_distinct(F.transform("_p", lambda x: x.phone)), F.array().cast("array<string>")).alias("phones"), "source", "corp_number")


def ad_evidence(companies: DataFrame, result_pages: DataFrame) -> DataFrame:
    """(id, score, rank): an ad block of a stored result page with the company's domain gives 3, a page with it elsewhere
    2, an ad library hit 2; a quality column adds to it. companies(id, domain, quality), result_pages(id, kind, html)."""
    j = companies.join(result_pages, "id", "left")
    ads = F.regexp_extract_all(text(F.col("html")), F.lit(r"(?is)<[^>]*(?:data-text-ad|class=\"[^\"]*\bad\b[^\"]*\")[^>]*>.*?</(?:div|li)>"), F.lit(0))
    in_ad = F.exists(ads, lambda x: F.contains(x, F.col("domain")))
    s = F.when(F.col("kind") == "library", F.when(F.contains(text(F.col("html")), F.col("domain")), 2).otherwise(0)).when(in_ad, 3).when(F.contains(text(F.col("html")), F.col("domain")), 2).otherwise(0)
    total = j.withColumn("_s", s).groupBy("id").agg((F.coalesce(F.max("quality"), F.lit(0)) + F.coalesce(F.sum("_s"), F.lit(0))).cast("int").alias("score"))
    return total.withColumn("rank", score_to_rank(F.col("score")))


def guess_site(result_pages: DataFrame, bad: list[str]) -> DataFrame:
    """(page_id, site): the first cited host that isn't bad."""
    cites = F.regexp_extract_all(text(F.col("html")), F.lit(r"(?is)<cite[^>]*>(.*?)</cite>"), F.lit(1))
    each = result_pages.select("page_id", F.posexplode(cites).alias("pos", "c")).withColumn("site", F.regexp_extract(visible_text(F.col("c")), r"^(?:https?://)?([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 1)).filter("site <> ''")
    good = each.filter(~host_contains_any(F.concat(F.lit("https://"), F.col("site")), bad))
    return first_per_key(good, "page_id", "pos").select("page_id", F.lower("site").alias("site"))


def case_clients(pages: DataFrame, excluded: list[str]) -> DataFrame:
    """(page_id, client, site): client and official site of case-study pages, from labels, headings and titles."""
    pages = spread(pages.select("page_id", "url", "html"), "page_id")
    said = visible_text_lines(F.col("html"))
    label = F.regexp_extract(said, r"(?:導入企業|お客様名|企業名|会社名|クライアント)\s*[：:]?\s*\n?([^\n：:]{2,60})", 1)
    form = r"((?:株式会社|有限会社|合同会社)[^\s|｜]{2,20}|[^\s|｜]{2,20}(?:株式会社|有限会社|合同会社))"
    title = F.regexp_extract(_inner(text(F.col("html")), "h1"), form, 1)
    title2 = F.regexp_extract(_inner(text(F.col("html")), "title"), form, 1)
    good = lambda c: F.when(is_valid_company_labelled(F.trim(c)), F.trim(c))
    names = pages.select("page_id", _worked_out(F.coalesce(good(label), good(title), good(title2))).alias("client"))
    out = links(pages).filter(has(F.col("said"), "公式|サイト|ホームページ|https?://")).withColumn("site", resolve_link(F.col("url"), F.col("href"), True)).filter("site is not null")
    out = out.filter((host(F.col("site")) != host(F.col("url"))) & ~host_contains_any(F.col("site"), excluded))
    return names.join(first_per_key(out, "page_id", "pos").select("page_id", "site"), "page_id", "left").select("page_id", "client", "site")


