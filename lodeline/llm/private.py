"""Private items in free text: find them, replace them by typed pseudonyms.

Items are e-mail addresses, phone numbers, identity numbers, street addresses and the
names of private people. A text is read in its one form (:mod:`.lookalike`), so spaces
that do not break, full-width digits, look-alike letters and invisible characters hide
nothing; positions always refer to the text as stored.

A replacement is ``[kind:pseudonym]``. Numbers and dates that are validated (a phone
format, a check character, a calendar date) are permuted within their format by a keyed
Feistel network and written with the separators and prefix they had, so equal values get
equal digits in every document, however they were written; a pseudonym of a citizen number is
again a number with a real date and a right check character, that of a mobile number again a
mobile number. Items without a number format (names, e-mail addresses, streets) get a keyed
code of eleven characters of their normal form (:func:`normal`).

Null texts have no items and stay null, as does every other column; empty texts stay
empty; long texts are read whole; repeated rows give repeated items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookalike import fold_with_offsets

# Common Chinese family names a personal name may start with.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤"
    "温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷曲盛冉翁蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝官封谈匡鞠惠荆乐冀郁胥南班储原栗燕楚鄢闻骆庾"
)

_CITIZEN_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CITIZEN_CHECKS = "10X98765432"
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_SIGN = r"[A-Za-z0-9]"
_AT = r"(?:@|\s?[\[(（]\s?at\s?[\])）]\s?|\s(?:at)\s(?=[A-Za-z0-9-]+\s?(?:[\[(（]dot[\])）]|dot)\s))"
_DOT = r"(?:\.|\s?[\[(（]\s?dot\s?[\])）]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])({_SIGN}[A-Za-z0-9_%+-]*(?:{_DOT}[A-Za-z0-9_%+-]+)*){_AT}([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)", re.I)

_B, _E = r"(?<![0-9A-Za-z@.+-])", r"(?![0-9A-Za-z])"
_NUM_END = r"(?![0-9A-Za-z]|[-.][0-9])"
PHONE = re.compile(
    "|".join(
        (
            r"(?<![0-9A-Za-z+])(?:(?:\+|00)86[ -]?)?1[3-9]\d(?:[ -]?\d{4}){2}" + _NUM_END,
            r"(?<![0-9A-Za-z+(-])(?:\(0\d{2,3}\) ?|0\d{2,3}-)\d{7,8}" + _NUM_END,
            r"(?<![0-9A-Za-z+])\+1[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}" + _NUM_END,
            r"(?<![0-9A-Za-z+(.-])(?:\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}([.-])\d{3}\1\d{4})" + _NUM_END,
            r"(?<![0-9A-Za-z+])(?:\+44 ?7\d{3}|07\d{3})[ -]?\d{6}" + _NUM_END,
            r"(?<![0-9A-Za-z+])\+33 ?[1-9](?:[ .-]?\d{2}){4}" + _NUM_END,
            r"(?<![0-9A-Za-z+])\+49 ?\d{2,4}[ /-]?\d{3,8}(?:[ -]\d{2,5})?" + _NUM_END,
            r"(?<![0-9A-Za-z+])\+(?!1\b|86|33|44|49)\d{1,3}(?:[ .-]?\d{2,4}){2,4}" + _NUM_END,
        )
    )
)
#: Words before a number, whatever signs and spaces are between, that say it is no phone number; none is longer than ``LABEL`` characters.
NO_PHONE, LABEL = re.compile(r"(?:订单号?|单号|题号|货号|页码|商品号?|书号|isbn|order(?: no\.?| number)?|item(?: no\.?)?|pages?|part no\.?|sku|code|编号|ref\.?)$", re.I), 16
CITIZEN = re.compile(r"(?<![0-9A-Za-z])(\d{6})([ -]?)((?:18|19|20)\d{6})\2(\d{3}[0-9Xx])(?![0-9A-Za-z])")
LETTERED = re.compile(r"(?<![0-9A-Za-z-])(\d{8})-?([A-Za-z])(?![0-9A-Za-z])")
GROUPED = re.compile(r"(?<![0-9A-Za-z-])(\d{3})-(\d{2})-(\d{4})(?![0-9A-Za-z]|-[0-9])")

_HAN = "一-鿿"
ADDRESS_ZH = re.compile(rf"(?:[{_HAN}]{{2,4}}省)?[{_HAN}]{{2}}[市县区](?:[{_HAN}]{{2,3}}[区县镇])?[{_HAN}]{{2,4}}(?:大道|路|街|巷|道|弄|胡同)\d{{1,5}}号(?:\d+(?:栋|单元|室|楼|号楼|幢)?)*")
_W = r"[^\W\d_]+"
ADDRESS_EN = re.compile(
    "|".join(
        (
            rf"(?<!\w)(?:Flat \d+, ?)?\d{{1,5}} (?:{_W} ){{1,2}}(?:Street|Road|Avenue|Ave|Lane|Drive|Square|Boulevard|Blvd|St|Rd|Ln|Dr)\b(?:\.?,? (?:Apt|Suite|Unit|Flat)\.? \d+)?",
            rf"(?<!\w)\d{{1,5}},? (?:rue|avenue|boulevard|place|chemin) (?:de la |des |du |de |d')?{_W}",
            rf"(?<!\w)(?:Calle|Avenida|Rua|Via|Plaza|Paseo) (?:de la |del |de |da |do )?{_W},? \d{{1,5}}\b",
            rf"(?<!\w){_W}(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ring) ?\d{{1,4}}\b",
            rf"(?<!\w){_W} (?:Lane|Road|Street|Avenue|Square|Drive) \d{{1,5}}\b",
        )
    ),
    re.I,
)

_GIVEN = rf"[{_HAN}]{{1,2}}"
NAME_ZH = re.compile(
    rf"(?:我叫|我是|本人叫?|姓名(?:是|[:：])?|名字(?:是|叫|[:：])?|署名(?:[:：])?|联系人(?:[:：])?|收件人(?:[:：])?|(?:班主任|老师|孩子|儿子|女儿|同桌|学生|家长)(?:叫|是|[:：])|(?:班主任|老师))\s?((?:{'|'.join(('欧阳', '司马', '上官', '诸葛'))}|[{SURNAMES}]){_GIVEN})(?![{_HAN}])"
    rf"|家长\s?([{SURNAMES}]{_GIVEN})(?=留)|学生\s?([{SURNAMES}]{_GIVEN})(?=同学)|(?<![{_HAN}])([{SURNAMES}]{_GIVEN})(?=同学|老师留|先生|女士)"
)
_P = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PERSON = rf"{_P} (?:(?:van|von|de|da|di|la|le|del|ben|bin|al)(?: der| den)? |[^\W\d_]\.? )?{_P}"
NAME_EN = re.compile(
    rf"(?:\b(?:my name is|i am|i'm|this is|me llamo|mi nombre es|je m['’]appelle|je suis|ich heiße|ich heisse|ich bin|meu nome é|my teacher is|my (?:son|daughter|child|kid|friend|husband|wife|brother|sister) is|for my (?:son|daughter|child|kid)|signed|yours|regards)[,:]?|\b(?:pupil|student|name|parent|teacher|contact|attn)\s?:)\s(?:(?:Dr|Ms|Mr|Mrs|Prof|Miss)\.? )?({_PERSON})"
    rf"|\b(?:Dr|Ms|Mr|Mrs|Prof)\.? ({_PERSON})",
    re.I,
)
#: Words no personal name begins with or consists of.
NO_NAME = frozenset(
    "a an the to of for in on at with and or not so very too my your his her their our this that it is are was be been i you we they from by as about into really just still also tired looking trying reading going learning studying working asking here there now new good bad sure sorry happy sad please thanks hello"
    " reader workbook college school academy course class kit guide file atlas list drill prize book field poetry physics chemistry history algebra coding spelling essay".split()
)

# What each kind of item needs, as cheap tests without false negatives.
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ .()/-]{0,2}[0-9]){6}")
_AT_WORDS = ("[at", "(at", "（at", "[ at", "( at", " at ")
_STREETS = ("street", "road", "ave", "lane", "drive", "square", "boulevard", "blvd", " st", " rd", " ln", " dr", "rue", "place", "chemin", "calle", "rua", "via", "plaza", "paseo", "stra", "str.", "weg", "gasse", "allee", "platz", "damm", "ring ")
_BEFORE_NAMES = ("name", "i am ", "i'm", "this is", "llamo", "nombre", "appelle", "je suis", "ich ", "nome", "teacher", "my son", "my daughter", "my child", "my kid", "my friend", "my husband", "my wife", "my brother", "my sister", "signed", "yours", "regards", "pupil", "student", "parent", "contact", "attn", "dr.", "dr ", "ms.", "ms ", "mr.", "mr ", "mrs", "prof")
_NEAR_NAMES = re.compile("[叫是人名署任师子儿桌生长学先女]")


def citizen_ok(s: str) -> bool:
    """Whether 18 characters have a real date and the ISO 7064 MOD 11-2 check character."""
    try:
        date(int(s[6:10]), int(s[10:12]), int(s[12:14]))
    except ValueError:
        return False
    return _CITIZEN_CHECKS[sum(int(a) * w for a, w in zip(s, _CITIZEN_WEIGHTS)) % 11] == s[17].upper()


def letter_ok(digits: str, letter: str) -> bool:
    return _LETTERS[int(digits) % 23] == letter.upper()


def _free(taken: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return all(b <= x or a >= y for x, y, _ in taken)


def _labelled(text: str, at: int) -> bool:
    while at and (text[at - 1] in ":：#" or text[at - 1].isspace()):
        at -= 1
    return bool(NO_PHONE.search(text[max(0, at - LABEL) : at]))


def items(text: str) -> list[tuple[int, int, str]]:
    """Items of a text in its one form: (start, end, kind), by start."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if "@" in text or any(w in low for w in _AT_WORDS):
        for m in EMAIL.finditer(text):
            out.append((m.start(), m.end(), "email"))
    if _DIGIT.search(text):
        if _NUMBER.search(text):
            for m in CITIZEN.finditer(text):
                if citizen_ok(m[1] + m[3] + m[4]) and _free(out, *m.span()):
                    out.append((*m.span(), "id_number"))
            for m in LETTERED.finditer(text):
                if letter_ok(m[1], m[2]) and _free(out, *m.span()):
                    out.append((*m.span(), "id_number"))
            for pattern, kind in ((GROUPED, "id_number"), (PHONE, "phone")):
                for m in pattern.finditer(text):
                    if _free(out, *m.span()) and not _labelled(text, m.start()):
                        out.append((*m.span(), kind))
        if "号" in text:
            for m in ADDRESS_ZH.finditer(text):
                a = m.start() + _cue_in(m[0])
                if _free(out, a, m.end()):
                    out.append((a, m.end(), "address"))
        if any(w in low for w in _STREETS):
            for m in ADDRESS_EN.finditer(text):
                if _free(out, *m.span()):
                    out.append((*m.span(), "address"))
    if not text.isascii() and _NEAR_NAMES.search(text):
        for m in NAME_ZH.finditer(text):
            g = m.lastindex
            if _free(out, *m.span(g)):
                out.append((*m.span(g), "name"))
    if any(w in low for w in _BEFORE_NAMES):
        at = 0
        while m := NAME_EN.search(text, at):
            g = m.lastindex
            at = m.start() + 1
            words = re.findall(r"[^\W\d_]+", m[g].lower())
            if words[0] in NO_NAME or words[-1] in NO_NAME or len(words[0]) < 2 or not _free(out, *m.span(g)):
                continue
            out.append((*m.span(g), "name"))
            at = m.end(g)
    return sorted(out)


def _cue_in(s: str) -> int:
    """Characters of a Chinese address match that belong to the words before it."""
    m = re.match(r"(?:地址是?|收货地址|寄到|住在|家在|我住在|在|送到|发到|到)", s)
    return m.end() if m and re.match(rf"[{_HAN}]{{2,}}?[市县区省]", s[m.end() :]) else 0


# ---------------------------------------------------------------------------- pseudonyms


def _round(key: bytes, i: int, value: int, mod: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d:%d" % (i, value), key=key, digest_size=16).digest(), "big") % mod


def feistel(n: int, size: int, key: bytes, rounds: int = 10) -> int:
    """A keyed permutation of ``range(size)``: an unbalanced Feistel network, walked until it falls inside."""
    if size < 2:
        return n
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right, x, y = n // b, n % b, a, b
        for i in range(rounds):
            left, right, x, y = right, (left + _round(key, i, right, x)) % x, y, x
        n = left * b + right
        if n < size:
            return n


def permute_digits(digits: str, key: bytes) -> str:
    return str(feistel(int(digits), 10 ** len(digits), key + b"d%d" % len(digits))).zfill(len(digits))


_FIRST, _LAST = date(1800, 1, 1), date(2099, 12, 31)


def permute_date(yyyymmdd: str, key: bytes) -> str:
    d = date(int(yyyymmdd[:4]), int(yyyymmdd[4:6]), int(yyyymmdd[6:]))
    n = feistel((d - _FIRST).days, (_LAST - _FIRST).days + 1, key + b"date")
    return (_FIRST + timedelta(n)).strftime("%Y%m%d")


def _refill(value: str, new: str) -> str:
    """``value`` with its letters and digits replaced in order; other signs stay."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in value)


_SPELLED_AT, _SPELLED_DOT = re.compile(r"\s?[\[(（]\s?at\s?[\])）]\s?|\sat\s", re.I), re.compile(r"\s?[\[(（]\s?dot\s?[\])）]\s?|\sdot\s", re.I)
_PREFIX = re.compile(r"(?:\+|00)(86|44|33|49|1(?=\D*(?:\d\D*){10}$))\D*")
_ABROAD = re.compile(r"\+\d{2}\D*")


def _phone(value: str) -> tuple[str, str, str]:
    """(prefix as written, the rest as written, country) of a phone number; a number without a prefix is of the country of its format."""
    if m := _PREFIX.match(value):
        return value[: m.end()], value[m.end() :], m[1]
    if m := _ABROAD.match(value):
        return value[: m.end()], value[m.end() :], m[0][1:3]
    digits = re.sub(r"\D", "", value)
    if re.fullmatch(r"07\d{9}", digits):
        zero = value.index("0") + 1
        return value[:zero], value[zero:], "44"
    return "", value, "86" if re.fullmatch(r"1[3-9]\d{9}|0\d{9,11}", digits) else "1" if len(digits) == 10 else ""


def normal(value: str, kind: str) -> str:
    """What equal items have in common, however they are written."""
    if kind == "email":
        return _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", value)).replace(" ", "").casefold()
    if kind == "id_number":
        return re.sub(r"[^0-9A-Za-z]", "", value).upper()
    if kind == "phone":
        _, rest, country = _phone(value)
        return country + ":" + re.sub(r"\D", "", rest)
    return re.sub(r"[\s,.]+", " ", value.casefold()).strip()


def _permute_phone(country: str, digits: str, key: bytes) -> str:
    """Other digits of the same format: mobile prefixes, area codes and leading zeros remain ones."""
    key += country.encode()
    if country == "86" and re.fullmatch(r"1[3-9]\d{9}", digits):
        return "1" + str(feistel(int(digits[1:]) - 3 * 10**9, 7 * 10**9, key + b"m") + 3 * 10**9)
    if country == "1" and re.fullmatch(r"(?:[2-9]\d\d){2}\d{4}", digits):
        n = (int(digits[:3]) - 200) * 8_000_000 + (int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
        n, line = divmod(feistel(n, 800 * 8_000_000, key + b"n"), 10_000)
        area, office = divmod(n, 800)
        return f"{area + 200}{office + 200}{line:04d}"
    if country == "44" and digits.startswith("7"):
        return "7" + permute_digits(digits[1:], key + b"m")
    zeros = len(digits) - len(digits.lstrip("0"))
    rest = digits[zeros:]
    if not rest:
        return digits
    low = 10 ** (len(rest) - 1)
    return "0" * zeros + str(feistel(int(rest) - low, 9 * low, key + b"z%d" % len(rest)) + low)


@lru_cache(maxsize=65536)
def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The pseudonym of an item in its one form."""
    if kind == "id_number":
        if m := CITIZEN.fullmatch(value):
            seventeen = permute_digits(m[1], key) + permute_date(m[3], key) + permute_digits(m[4][:3], key)
            return _refill(value, seventeen + _CITIZEN_CHECKS[sum(int(a) * w for a, w in zip(seventeen, _CITIZEN_WEIGHTS)) % 11])
        if m := LETTERED.fullmatch(value):
            d = permute_digits(m[1], key)
            return _refill(value, d + _LETTERS[int(d) % 23])
        return _refill(value, permute_digits(re.sub(r"\D", "", value), key))
    if kind == "phone":
        prefix, rest, country = _phone(value)
        return prefix + _refill(rest, _permute_phone(country, re.sub(r"\D", "", rest), key))
    code = hashlib.blake2b(normal(value, kind).encode(), key=key, digest_size=8, person=kind.encode()).digest()
    n = feistel(int.from_bytes(code, "big") % 36**11, 36**11, key + kind.encode())
    out = ""
    for _ in range(11):
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out


def redact_text(text: str | None, key: bytes) -> str | None:
    """A text with its items replaced, all else unchanged."""
    if text is None:
        return None
    form, at = fold_with_offsets(text)
    found = items(form)
    if not found:
        return text
    out, last = [], 0
    for a, b, kind in found:
        start = a if at is None else at[a]
        end = b if at is None else (at[b - 1] + 1 if b == len(at) else max(at[b - 1] + 1, _trim(text, at[b - 1] + 1, at[b])))
        if start < last:
            continue
        out.append(text[last:start])
        out.append(f"[{kind}:{pseudonym(form[a:b], kind, key)}]")
        last = end
    out.append(text[last:])
    return "".join(out)


def _trim(text: str, a: int, b: int) -> int:
    """End of an item whose last character is followed by characters that vanish: marks belong to it."""
    import unicodedata

    while a < b and unicodedata.combining(text[a]):
        a += 1
    return a


# ---------------------------------------------------------------------------- Spark


ITEM_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])


def find_private(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per item: ``row_id``, kind, start_pos and end_pos (characters before the item and up to its end, as stored).

    There is no shuffle: the scan reads two columns and one pass of Arrow batches finds the
    items. Null row ids are kept; null texts give no row.
    """
    rows = df.select(df[row_id].alias("row_id"), df[text].alias("text")).where(F.col("text").isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, starts, ends = [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form, at = fold_with_offsets(s)
                for a, b, kind in items(form):
                    ids.append(i)
                    kinds.append(kind)
                    starts.append(a if at is None else at[a])
                    ends.append(b if at is None else at[b - 1] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["row_id", "kind", "start_pos", "end_pos"])

    return rows.mapInArrow(scan, T.StructType([T.StructField("row_id", df.schema[row_id].dataType), *ITEM_SCHEMA.fields]))


def _secret(key: str) -> bytes:
    if not key:
        raise ValueError("pseudonyms need a key")
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def pseudonyms(df: DataFrame, row_id: str, text: str, key: str) -> DataFrame:
    """One row per item: ``row_id``, kind, value (a keyed digest of its normal form) and pseudonym in its normal form."""
    secret = _secret(key)
    rows = df.select(df[row_id].alias("row_id"), df[text].alias("text")).where(F.col("text").isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form, _ = fold_with_offsets(s)
                for a, b, kind in items(form):
                    value = hashlib.blake2b(normal(form[a:b], kind).encode(), key=secret, digest_size=16).hexdigest()
                    for c, v in zip(out, (i, kind, value, normal(pseudonym(form[a:b], kind, secret), kind))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *[pa.array(c, pa.string()) for c in out[1:]]], names=["row_id", "kind", "value", "pseudonym"])

    return rows.mapInArrow(scan, T.StructType([T.StructField("row_id", df.schema[row_id].dataType), *[T.StructField(c, T.StringType()) for c in ("kind", "value", "pseudonym")]]))


def links(df: DataFrame, row_id: str, text: str, key: str) -> DataFrame:
    """Per kind: items, different values, different pseudonyms, values in several rows, and whether each value has one pseudonym and each pseudonym one value."""
    each = pseudonyms(df, row_id, text, key)
    pairs = each.groupBy("kind", "value", "pseudonym").agg(F.count("*").alias("n"), F.min("row_id").alias("a"), F.max("row_id").alias("b"))
    values = pairs.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.count("*").alias("p"), F.min("a").alias("a"), F.max("b").alias("b"))
    by_value = values.groupBy("kind").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_values"), F.sum((F.col("a") < F.col("b")).cast("int")).alias("n_shared"), (F.max("p") == 1).alias("one_pseudonym"))
    by_pseudonym = pairs.groupBy("kind", "pseudonym").agg(F.count("*").alias("v")).groupBy("kind").agg(F.count("*").alias("n_pseudonyms"), (F.max("v") == 1).alias("one_value"))
    return by_value.join(by_pseudonym, "kind").select("kind", "n_items", "n_values", "n_pseudonyms", "n_shared", "one_pseudonym", "one_value")


def redact(df: DataFrame, text: str, out: str, key: str) -> DataFrame:
    """Add ``out``: ``text`` with every item replaced by ``[kind:pseudonym]``, under ``key`` (of which 32 bytes are used; an empty one is refused)."""
    secret = _secret(key)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([redact_text(x, secret) for x in s], index=s.index, dtype=object)

    return df.withColumn(out, run(df[text]))
