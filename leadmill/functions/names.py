"""Clean-up and validity of company names, as native expressions.

A raw name is tidied (marks, white space, abbreviations), freed of brackets and of what stands behind it, and then read as
words: the word that holds a legal form says which words are the name. In short

- 株式会社X among other words: that word alone;
- 株式会社 as a word of its own: all words before it, it, the next word and what follows up to an address;
- X株式会社: it with one word before it, or alone after two or more words; what follows goes;
- no legal form: the words up to one that ends with a kind of business, else all up to an address.

Notes in brackets go whatever their length, a company in brackets is the name unless the name itself begins with a legal
form, and a topic after a particle goes with all behind it. Run these on distinct raw names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.functions.text import BUSINESS_TYPE, JP_FORM, LEGAL_FORM, PAGE_WORDS, any_of, chain, cut_behind, cut_notes, expand_abbreviations, has, is_address_token, let, text, unescape_entities

# Roles of people, in words and by letters.
ROLES = ["代表取締役", "取締役", "代表", "会長", "社長", "副社長", "専務", "常務", "理事長", "院長", "所長", "オーナー", "主宰", "塾長", "校長", "園長", "施設長", "事業主", "センター長", "執行役員", "最高経営責任者"]
ROLE_LETTERS = ["CEO", "COO", "CFO", "CTO", "CMO", "CCO"]
# Words before a company's name that say what it does for another.
AGENTS = ["FC本部", "代理店", "フランチャイズ", "正規", "公認", "認定", "加盟"]
_LETTERS = "(?:" + "|".join(ROLE_LETTERS) + ")"
_ROLE = rf"(?: *(?:{'|'.join(ROLES)})(?:[ /]*{_LETTERS})*| +{_LETTERS}(?:[ /]+{_LETTERS})*)+$"
_GROUP = rf"(?:{JP_FORM}|ホールディングス)"
#: Kinds of words by the legal form that they hold.
_KINDS = {"alone": rf"^{JP_FORM}$", "leads": rf"^{JP_FORM}.", "ends": rf".{_GROUP}$"}


def _first(c: Column, pattern: str) -> Column:
    """The group where the pattern fits, else the text."""
    return let(F.regexp_extract(c, pattern, 1), lambda got: F.when(got != "", F.trim(got)).otherwise(c))


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(F.translate(unescape_entities(c), "©℗®™℠\ufe0e\ufe0f", ""), r"(?U)\s+", " ")
    front = r"(?i)^(?:copyright\b|[ ※▶◆□■▲★●◎◇▼►◄➤➔→←↑↓\[]|\d{4}(?: *[-–—] *\d{4})? )+"
    return F.trim(expand_abbreviations(F.regexp_replace(c, front, "")))


def _unbracketed(c: Column) -> Column:
    notes = rf"^(?:(?:【(?:(?!{LEGAL_FORM})[^】])+】|[（(](?:(?!{LEGAL_FORM})[^）)])+[）)]) *)+(?=\S)"
    inside = lambda x: F.when(has(x, f"^{JP_FORM}"), x).otherwise(_first(x, rf"[（(【]({JP_FORM}[^）)】]+)"))
    return chain(c, lambda x: _first(x, r"^[「『【\"](.+)[」』】\"]$"), lambda x: F.regexp_replace(x, notes, ""), inside, cut_notes)


def _up_to_address(words: Column) -> Column:
    """The words before the first that looks like part of an address."""
    at = F.array_position(F.transform(words, is_address_token), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(words, 1, at - 1)).otherwise(words)


def _after(words: Column, n: Column) -> Column:
    """The words after the first n."""
    return F.filter(words, lambda _, i: i >= n)


def _named_words(c: Column, *, agents: bool = False) -> Column:
    """The words that are the name. agents: an agent's word before X株式会社 goes too."""
    # a description without a space before the form ends with a particle
    words = F.transform(F.split(c, " "), lambda w: F.when(has(w, f"^{JP_FORM}"), w).otherwise(_first(w, rf"の({JP_FORM}.+)$")))
    words = F.transform(words, lambda w: _first(w, rf"^(.+?{_GROUP})の.+"))
    kind = lambda w: F.coalesce(*[F.when(has(w, p), k) for k, p in _KINDS.items()], F.when(has(w, rf"^.+{BUSINESS_TYPE}$"), "trade").otherwise(""))
    formed = lambda k: k.isin(*_KINDS)

    def chosen(w: Column, kinds: Column) -> Column:
        form = F.array_position(F.transform(kinds, formed), F.lit(True)).cast("int")
        trade = F.array_position(kinds, F.lit("trade")).cast("int")
        how = F.get(kinds, form - 1)
        agent = has(F.get(w, F.lit(0)), rf"^(?:[ァ-ヶー・]{{7,}}|(?:{'|'.join(AGENTS)}).*)$") if agents else F.lit(False)
        one, upto = F.slice(w, form, 1), F.slice(w, 1, form)
        rest = F.concat(upto, F.slice(w, form + 1, 1), _up_to_address(_after(w, form + 1)))
        loose = F.concat(F.slice(w, 1, 1), _up_to_address(_after(w, F.lit(1))))
        return (
            F.when(how == "leads", one).when(how == "alone", rest)
            .when(how == "ends", F.when((form >= 3) | ((form == 2) & agent), one).otherwise(upto))
            .when(trade > 0, F.slice(w, 1, trade)).otherwise(loose)
        )

    return F.array_join(let(words, lambda w: let(F.transform(w, kind), lambda k: chosen(w, k))), " ")


def _roleless(c: Column) -> Column:
    """Without roles at the end, where more than a legal form is left."""
    cut = F.trim(F.regexp_replace(c, _ROLE, ""))
    return F.when(has(c, LEGAL_FORM) & (F.length(cut) >= 3) & ~has(cut, f"^{JP_FORM}$"), cut).otherwise(c)


def _named(df: DataFrame, raw: str, out: str, step) -> DataFrame:
    """Adds the result of the step, worked out once for each distinct raw name."""
    names = df.select(F.col(raw).alias("_raw")).distinct()
    names = names.withColumn("_name", step(F.col("_raw")))
    return df.drop(out).join(names, F.col(raw).eqNullSafe(F.col("_raw")), "left").drop("_raw").withColumnRenamed("_name", out)


def normalized_name(c: Column) -> Column:
    """The normalised name; null gives the empty text."""
    return chain(text(c), _tidy, cut_behind, _unbracketed, cut_behind, lambda x: _named_words(x), _roleless)


def sanitized_name(c: Column) -> Column:
    """The last gate: normalised, without an agent's word before it; null where nothing is left, a kind of page is, or a long
    text without a legal form."""
    gate = lambda x: F.when((x != "") & ~x.isin(*PAGE_WORDS) & ((F.length(x) <= 25) | has(x, LEGAL_FORM)), x)
    return chain(text(c), _tidy, cut_behind, _unbracketed, cut_behind, lambda x: _named_words(x, agents=True), _roleless, cut_behind, gate)


def normalize_names(df: DataFrame, raw: str, out: str = "name") -> DataFrame:
    """Adds the normalised name."""
    return _named(df, raw, out, normalized_name)


def sanitize_names(df: DataFrame, raw: str, out: str = "name") -> DataFrame:
    """Adds the name that passes the last gate."""
    return _named(df, raw, out, sanitized_name)


# What is no company name, by its beginning.
_BAD = r"(?i)^(?:[©︎️]|\(C\)|Copyright|\d{4}|【|「|http|www\.|All Rights|Privacy|Terms|Policy|iPhone|Android|PC|お問い合わせ|ショッピング|カート|ログイン|メニュー|企業情報|会社情報|サービス情報|運営情報|運営者情報|本利用規約|本規約|利用規約|以下|募集代理店|PR\s*[：:]|広告|運営会社[/／]|販売業者[：:]?|事業者名[：:]?|商号[：:を]|屋号|例[：:＊\s]|例えば[：:＊\s]|例）|例示|サンプル[：:\s]|テスト[：:\s]|よくあるご質問|プライバシーポリシー|基本情報|価格プラン|家業を継が|オーナー専用|令和\S*年|ImageMagick|Google LLC|販売業者名|事業者名称)"
# Legal forms of professions, and of firms that can't be of theirs.
PROFESSIONS = ["行政書士法人", "司法書士法人", "弁護士法人", "税理士法人"]
FIRMS = ["株式会社", "有限会社"]
# Legal forms before `の` and what a slogan offers after it.
OWNERS = [*FIRMS, "合同会社", "一般社団法人", "医療法人", "社会福祉法人"]
OFFERS = ["サービス", "事業", "商品", "製品", "一覧", "ご案内", "情報", "詳細", "特徴", "ポイント", "ご提供", "ご紹介", "実績", "取り組み"]
# Marks of titles, remarks in brackets, services that found companies, ends of units; words of sentences.
TITLE_MARKS = ["|", "｜", "･", "。", "、"]
REMARKS = ["以下", "旧"]
FOUNDING = ["会社設立", "起業する", "起業なら", "起業を"]
UNITS = ["事業部", "営業所", "出張所"]
SENTENCE = ["として", "のため", "をお"]


def _holds(name: Column, words: list[str]) -> Column:
    return any_of(*[F.contains(name, F.lit(w)) for w in words])


def _slogan(name: Column) -> Column:
    """What a company offers stands after a `の` behind its name."""
    parts = F.split(name, "の")
    offered = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: any_of(*[F.startswith(p, F.lit(o)) for o in OFFERS]))
    return offered & any_of(*[F.contains(F.get(parts, F.lit(0)), F.lit(o)) & ~F.endswith(F.get(parts, F.lit(0)), F.lit(o)) for o in OWNERS])


def _common(name: Column) -> Column:
    """Names with forms of a profession and of a firm are rejected whatever their order and distance, slogans by their first
    `の` on; a longer remark in brackets is one of three characters or more."""
    remark = any_of(*[F.contains(name, F.lit(b + r)) for b in "(（" for r in REMARKS]) | has(name, "（[^）]{3,}）")
    twice = any_of(*[F.regexp_count(name, F.lit(f)) >= 2 for f in FIRMS])
    mixed = _holds(name, PROFESSIONS) & _holds(name, FIRMS)
    unit = any_of(*[F.endswith(name, F.lit(u)) for u in UNITS])
    return ~(_holds(name, TITLE_MARKS) | remark | _holds(name, FOUNDING) | unit | twice | mixed | _slogan(name) | has(name, _BAD) | has(name, f"^{JP_FORM}$"))


def is_valid_company(name: Column) -> Column:
    """Strict: of a normalised name; a legal form is needed."""
    return let(name, _strict)


def _strict(name: Column) -> Column:
    said = _holds(name, ["/", "／", *SENTENCE]) | has(name, "[ぁ-ん]なら|なら[ぁ-ん]")
    return F.length(name).between(4, 60) & has(name, LEGAL_FORM) & _common(name) & ~said


def is_valid_company_labelled(name: Column) -> Column:
    """After a label: a kind of business will do if two more characters are there."""
    return let(name, _labelled)


def _labelled(name: Column) -> Column:
    bare = F.regexp_replace(text(name), r"(?U)\s+", "")
    trade = has(name, BUSINESS_TYPE) & (F.length(F.regexp_replace(bare, BUSINESS_TYPE, "")) >= 2)
    return (F.length(bare) >= 2) & (F.length(name) <= 80) & _common(name) & ~has(name, r"^[\d\s\-()+]+$|https?://|[ぁ-ん]の|のため|として|について|に関する|をお|にて|より") & (has(name, LEGAL_FORM) | trade)
