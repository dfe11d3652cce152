"""Template residue, filler and error-page text: positive-unlabelled naive Bayes by expectation-maximization."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.skew import spread_join
from loomwright.session import cut, spread

#: Size of the hashed table of features; it bounds what is gathered, whatever the corpus.
FEATURES = 1 << 18
#: Weight of an unlabelled unit's posterior among the positives. Below one, so that no unit confirms itself.
UNLABELLED = 0.5
#: Expectation-maximization ends once the expected number of residue units moves by less than this share of it.
TOLERANCE = 1e-3
MAX_ROUNDS = 200
#: Features that a class's shares are shrunk by, and the most that one feature can say.
SHRINK, MOST_ODDS = 100.0, 6.0
#: Kinds of units: placeholders with nothing around them, those within a sentence, passages. Each has a model of its own.
KINDS = ("alone", "slot", "passage")
#: A placeholder is trusted if at least this share of its contexts' occurrences, on both sides, is filled in.
FILLED = 0.9
#: Bits of the filter per placeholder context, and its bounds. The filter only saves work: counts are exact.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 30
#: Passages remembered per worker; only saves time.
REMEMBERED = 100_000

# How unfilled placeholders look, by sort.
SHAPES = [
    ("mustache", r"\{\{\s*[\w. -]{1,40}\s*\}\}"),
    ("dollar", r"\$!?\{[^{}\s]{1,40}\}"),
    ("hash", r"#\{[\w.]{1,40}\}"),
    ("erb", r"<%=?\s*[\w. ]{1,40}\s*%>"),
    ("tag", r"\{%[^%]{1,60}%\}(?:\s*\{%[^%]{1,60}%\})*"),
    ("wiki", r"\[\[[\w. ]{1,40}\]\]"),
    ("at", r"@@[\w.]{1,40}@@"),
    ("dunder", r"__[A-Z][A-Z_]{1,40}__"),
    ("percent", r"%[A-Z][A-Z_]{2,40}%"),
    ("index", r"\{\d{1,2}\}"),
    ("brace", r"\{(?:[A-Za-z_]\w{0,30}|[\u4e00-\u9fff]{2,12})\}"),
    ("lenticular", r"【[^【】]{2,12}】|［待[^［］]{1,16}］|\[待[^\[\]]{1,16}\]"),
    ("fill_here", r"[（(]此处填写[^（()）]{0,16}[)）]|[<＜]请填写[^<>＜＞]{0,16}[>＞]|<(?:describe|insert|enter|your) [^<>]{1,40}>"),
    ("your", r"\[(?:YOUR|Your|INSERT|Insert|ENTER|Enter) [^\[\]]{1,40}\]|\[[^\[\]]{1,40} goes here\]"),
    ("angle", r"<<\s*[\w .]{1,40}\s*>>|(?<![\w<])<(?!(?:noscript|div|span|p|br|b|i|a|table|tr|td|html|body|head|ul|li|s|pad|unk|mask)\b)[a-z][a-z_]{2,20}(?: [a-z]+){0,3}>(?!>)"),
    ("to_do", r"\((?:to be (?:completed|defined|filled in|determined)|tbd)\)|\bTB[DCA]\b"),
    ("crosses", r"(?<![A-Za-z0-9])X{3,}(?![A-Za-z])|×{3,}|[12]\d?XX年X{1,2}月X{1,2}日"),
    ("line", r"(?<![_\w])_{4,}(?![_\w])"),
    ("undefined", r"(?<![\w.])undefined(?![\w.])|\[object Object\]|(?<!\w)NaN(?!\w)"),
]
_SHAPE = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in SHAPES))
#: What every shape holds, for a quick look.
HINT = r"[{\[<%@_×【［＜]|XX|\(t|TB[DCA]|undefined|NaN|此处填写"
_HINT = re.compile(HINT)

# Passages, in lower case, that are trusted to be filler, error messages, or notices about scripts, cookies
# and browsers.
TRUSTED = [
    ("filler", r"^(?:lorem ipsum|dolor sit amet)\b|lorem ipsum dolor|\b(?:text ){2,}text\b|^(?:sample|dummy|example|placeholder) text\.?$|^(?:text){3,}|^beispieltext|^texte d'exemple|^texto de ejemplo|(?:your|the) (?:content|text) goes here|^enter the (?:description|text)|^this is a dummy|^(?:(?:asdf(?:gh)?|qwer(?:ty)?|zxcv|jkl|xxx|foo|bar|blah|test\d*)[\s.,;]*){2,}$|请在此输入|^示例文字|^(?:这里是正文|标题文字|占位文字|文本文本)"),
    ("error", r"^(?:http status |error |错误 ?|erreur |fehler )?[45]\d\d(?:[ :–-]+(?:[a-z]+ ){0,3}(?:bad request|unauthorized|forbidden|not found|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out))?\.?$|^http status [45]\d\d|^(?:access denied|permission denied|internal server error|bad gateway|service unavailable|error page)\.?$|(?:page|file|document) (?:you requested )?(?:could not be found|does not exist|was not found)|do not have permission to|session has (?:ended|expired)|could not connect to the database|down for maintenance|unexpected error \(type=|^traceback \(most recent call last|^(?:caused by: )?(?:[a-z_]\w*\.)+[a-z]\w*(?:error|exception)\b|^\w+error: |^at (?:[\w$]+\.)+[\w$<>]+\(|the origin could not handle|^\{\"(?:code|status|error)\": ?[\"']?[45]|(?:页面|文件|文档)(?:不存在|不见了|已被删除)|您要找的页面|没有权限访问|登录(?:状态)?已(?:失效|过期)|系统繁忙|服务器(?:开小差|内部错误|繁忙)|^错误码[:：]|加载失败[:：]|访问过于频繁|se encuentra la página|page demandée est introuvable|seite (?:wurde )?nicht gefunden|ページが見つかりません|페이지를 찾을 수 없습니다|страница не найдена"),
    ("script", r"(?:enable|activate|allow|requires?|needs?) (?:javascript|scripts|cookies)|javascript is (?:disabled|switched off|required|turned off)|browser is (?:outdated|not supported|too old)|checking your browser|scripts and cookies must|<noscript>|(?:启用|开启|打开) ?(?:javascript|脚本)|(?:未开启|未启用|不支持|禁用了?) ?(?:javascript|脚本)|需要 ?(?:启用脚本|javascript)|检查脚本是否被拦截|浏览器版本过低|正在检查您的浏览器|aktivieren sie javascript|activer javascript|active javascript|activez javascript|javascriptを有効|자바스크립트를 켜|включите javascript"),
]
_TRUSTED = [(name, re.compile(pattern)) for name, pattern in TRUSTED]

_FENCE = re.compile(r"```[\s\S]*?```|~~~[\s\S]*?~~~|`[^`\n]+`")
_LOG = re.compile(r"^\s*\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\S*\s+(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b\s*(?:\[[^\]]*\]\s*)?")
_QUOTED = re.compile(r"“[^“”]{1,60}”|「[^「」]{1,60}」|『[^』]{1,60}』|‘[^‘’]{1,60}’|(?<![^\s(（])'[^'\n]{1,60}'(?![^\s.,;:!?)）])|(?<![^\s(（{:,])\"[^\"\n]{1,60}\"(?![^\s.,;:!?)）])|«[^«»]{1,60}»")
_PATH = re.compile(r"(?:https?:/)?(?:/[\w.{}%~:-]+){2,}(?:\?\S*)?|/[\w.-]+/\S*")
_ITEM = re.compile(r"^\s*(?:[#>*•-]+\s+|\d+[.)]\s+|REQ-\d+[:：]\s*|《)+")
_LABEL = re.compile(r"^([^\s:：{}<>\[\]]{1,16}(?: [^\s:：{}<>\[\]]{1,12})?)\s?[:：]\s*")
_REPEAT = re.compile(r"(\S{2,8}?)\1{3,}")
_SENTENCE = re.compile(r"(?<=[。！？!?])|(?<=[.;])\s+")
_TOKEN = re.compile(r"[㐀-鿿぀-ヿ가-힣]+|[^\W\d_㐀-鿿぀-ヿ가-힣]+|\d+|[<>{}|]")
_CJK = re.compile(r"[㐀-鿿぀-ヿ가-힣]")


_RESPONSE = re.compile(r"^\s*\{\"\w+\":")


def _hash(text: str, size: int) -> int:
    return xxhash.xxh64_intdigest(text) & (size - 1)


def _shaped(text: str) -> bool:
    return _HINT.search(text) is not None and _SHAPE.search(text) is not None


def lines(text: str) -> Iterator[tuple[str, bool]]:
    """(line, whether it is a log line) outside code, without list marks and log prefixes; quotations and paths blanked,
    but not the strings of a bare response object."""
    for line in re.split(r"[\r\n]+", _FENCE.sub("\n", text.replace("﻿", ""))):
        log = _LOG.match(line)
        line = line[log.end() :] if log else line
        line = _ITEM.sub("", line)
        line = _PATH.sub(" ", line if _RESPONSE.match(line) else _QUOTED.sub(" ", line)).strip().strip("》").strip()
        if line:
            yield line, bool(log)


def _fold(text: str) -> str:
    return re.sub(r"\d+", "0", text.lower())


#: Characters of a context: beside Han, kana or hangul, and beside other characters.
NEAR_CJK, NEAR_OTHER = 3, 10
_EDGE = "\n" * NEAR_OTHER


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n characters."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64)
    h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k]
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _side(text: str, left: bool) -> str | int:
    """edge (nothing there), start (a sentence's edge), or the hash of the characters next to a placeholder."""
    text = _fold(text)
    if not text.strip(" 。.!！；;，,:：-"):
        return "edge"
    if re.search(r"[。！？]\s*$|[.!?]\s+$", text) if left else re.match(r"[。！？]|[.!?]\s", text):
        return "start"
    near = text.rstrip()[-1:] if left else text.lstrip()[:1]
    n = NEAR_CJK if _CJK.match(near) else NEAR_OTHER
    return int(_gram_hashes(_codes((_EDGE + text)[-n:] if left else (text + _EDGE)[:n]), n)[0])


def slots(line: str) -> Iterator[tuple[str | int, str | int, str]]:
    """(left side, right side, the sentence around it) of each placeholder of a line; placeholders close to each other share
    their outer sides. A field label with its colon, at the start of the line or of the sentence, counts as an edge."""
    found = [m.span() for m in _SHAPE.finditer(line)]
    label = _LABEL.match(line)
    start = label.end() if label and not any(a < label.end() for a, _ in found) else 0
    groups: list[list[int]] = []
    for a, b in found:
        if groups and a - groups[-1][1] < 8:
            groups[-1][1] = b
        else:
            groups.append([a, b])
    for a, b in groups:
        left, right = re.split(_SENTENCE, line[start:a])[-1], re.split(_SENTENCE, line[b:])[0]
        yield "edge" if _LABEL.fullmatch(left) else _side(line[start:a], True), _side(line[b:], False), _SHAPE.sub(" ", f"{left} {right}")


def words(passage: str) -> list[str]:
    """Words without case, Han and kana in overlapping pairs, numbers by their length and leading digit, repeats."""
    out = []
    for m in _TOKEN.finditer(passage.lower()):
        w = m[0]
        if _CJK.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif w.isdigit():
            out.append(f"#{len(w)}{w[0] if len(w) == 3 else ''}")
        else:
            out.append(w)
    repeat = _REPEAT.search(re.sub(r"[\s.\-_=*#|]", "", passage))
    if repeat and len(set(repeat[1])) > 1:
        out += ["<repeat>"] * 4
    return out


def tokens(passage: str) -> list[str]:
    """Words, and pairs of a word that is not in Han, kana or hangul with the one before it."""
    single = words(passage)
    return single + [f"{a} {b}" for a, b in zip(["^", *single], single) if not _CJK.match(b)]


def passages(line: str) -> list[str]:
    return [p for p in (s.strip() for s in _SENTENCE.split(line) if s) if p]


def trusted(passage: str) -> str | None:
    """The sort of residue that a passage is trusted to be, or None."""
    lower = passage.lower()
    for sort, pattern in _TRUSTED:
        if pattern.search(lower):
            return sort
    repeat = _REPEAT.search(re.sub(r"\s", "", passage))
    if repeat and len(repeat[0]) >= 0.8 * len(re.sub(r"\s", "", passage)) and re.search(r"\w", repeat[1]) and len(set(repeat[1])) > 1:
        return "filler"
    return None


# Words by which a passage speaks about such things instead of being one.
_RULE = re.compile(r"\b(?:shall|must(?! be on)|should|waits?|expects?|types|review|rule \d|defect|returns?|reported|accept)\b|须|应(?!用)|时，|不得|用例|规则|返回 ?[45]\d\d", re.I)


def _normative(passage: str) -> bool:
    return bool(_RULE.search(passage)) and not re.search(r"[您请抱歉]|^[\w.]+(?:error|exception)|\byour?\b|^<", passage, re.I)


def _features(kind: int, feats: list[str]) -> bytes:
    return np.array([_hash("PT"[kind] + f, FEATURES) for f in feats], dtype=np.int32).tobytes()


def _unit(features: bytes) -> int:
    return xxhash.xxh64_intdigest(features) - (1 << 63)


class _Passages(dict):
    """What is known of a passage: (sort, trusted, unit, features), or None if it has no words."""

    def __missing__(self, passage: str) -> tuple | None:
        feats, known = tokens(passage), None
        if feats:
            sort, features = trusted(passage), _features(1, feats)
            known = (sort or "passage", sort is not None and not _normative(passage), _unit(features), features)
        if len(self) >= REMEMBERED:
            self.clear()
        self[passage] = known
        return known


def _asked(docs: DataFrame) -> DataFrame:
    """(context, p): contexts of placeholders, and how many documents have each so."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sides = [x for text in b["text"] for x in {x for line, _ in lines(text) if _shaped(line) for slot in slots(line) for x in slot[:2] if isinstance(x, int)}]
            at, n = np.unique(np.array(sides, dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"context": at, "p": n.astype(np.int64)})

    shaped = docs.where(F.col("text").rlike(HINT)).select("text")
    return shaped.mapInPandas(ask, "context long, p long").groupBy("context").agg(F.sum("p").alias("p"))


def _filter(asked: DataFrame) -> np.ndarray:
    """Bits of the contexts' hashes, as bytes: at most MOST_BITS bits, so that many contexts share bits, never fewer."""
    bits = LEAST_BITS
    n = asked.count()
    while bits < min(FILTER_BITS * n, MOST_BITS):
        bits *= 2
    place = F.col("context").bitwiseAND(F.lit(bits - 1)) + 1
    got = asked.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toPandas()  # at most MOST_BITS / 32768 rows of 4 KB
    out = np.zeros((bits // 32768, 4096), dtype=np.uint8)
    for bucket, part in zip(got["bucket"], got["bits"]):
        out[bucket - 1] = np.frombuffer(bytes(part), dtype=np.uint8)
    return out.reshape(-1)


def _count_contexts(seen: dict[str, int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, occurrences) that pass the filter, in lines that occur so often each; with edges between the lines."""
    hits, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if seen:
        folded = [_EDGE + _fold(line) for line in seen]
        codes = _codes("".join(folded) + _EDGE)
        often = np.repeat(np.fromiter(seen.values(), dtype=np.int64, count=len(seen)), [len(x) for x in folded])
        for n in (NEAR_CJK, NEAR_OTHER):
            h = _gram_hashes(codes, n)
            place = h & (len(bits) * 8 - 1)
            hit = ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).nonzero()[0]
            hits.append(h[hit])
            times.append(often[np.minimum(hit, len(often) - 1)])
    at, inverse = np.unique(np.concatenate(hits), return_inverse=True)
    return at, np.bincount(inverse, weights=np.concatenate(times), minlength=len(at)).astype(np.int64)


_ROW = [("kind", T.StringType()), ("sort", T.StringType()), ("sure", T.BooleanType()), ("unit", T.LongType()), ("features", T.BinaryType()), ("left", T.StringType()), ("right", T.StringType()), ("n", T.LongType())]


def _parsed(docs: DataFrame, bits, id_type) -> DataFrame:
    """All that is read from the texts, in one pass. Rows of kind T: a row per document and different passage, with its
    features once per batch. P: a row per placeholder with its sides, and the words around it as features. C: a context
    of placeholders (unit) that occurs n times filled in, equal lines of a document counting once."""
    schema = T.StructType([T.StructField("_id", id_type), *[T.StructField(*x) for x in _ROW]])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = _Passages(), bits.value
        for b in batches:
            out, filled, sent = [], {}, set()
            for i, text in zip(b["_id"], b["text"]):
                own, plain = set(), set()
                for line, log in lines(text):
                    shaped = _shaped(line)
                    if shaped:
                        for left, right, around in slots(line):
                            out.append((i, "P", "placeholder", False, None, _features(0, ["w " + w for w in words(around)]), str(left), str(right), None))
                    else:
                        label = _LABEL.match(line)
                        plain.add(line[label.end() :] if label else line)
                    if log:
                        continue
                    for passage in passages(line):
                        if not (shaped and _shaped(passage)):
                            unit = known[passage]
                            if unit:
                                own.add(unit)
                for line in plain:
                    filled[line] = filled.get(line, 0) + 1
                for sort, sure, unit, features in own:
                    key = (sort, sure, unit)
                    out.append((i, "T", sort, sure, unit, None if key in sent else features, None, None, None))
                    sent.add(key)
            out += [(None, "C", None, None, int(h), None, None, None, int(n)) for h, n in zip(*_count_contexts(filled, table))]
            yield pd.DataFrame(out, columns=schema.names, dtype=object)  # nulls must not turn the hashes into floats

    return docs.mapInPandas(parse, schema)


def _bin(share) -> str:
    """A side of a placeholder: edge, start, or how much of its occurrences is filled in."""
    return share if isinstance(share, str) else "never" if share == 0 else "seldom" if share < 0.5 else "often" if share < FILLED else "mostly"


def _placeholders(rows: DataFrame, asked: DataFrame, id_type) -> DataFrame:
    """Units of placeholders: (_id, sort, sure, unit, features). Trusted are those at an edge or after a label, and those
    between contexts that are mostly filled in (or a sentence's edge)."""
    filled = rows.where("kind = 'C'").groupBy(F.col("unit").alias("context")).agg(F.sum("n").alias("f"))
    share = F.coalesce(F.col("f"), F.lit(0)) / (F.coalesce(F.col("f"), F.lit(0)) + F.col("p"))
    shares = cut(asked.join(filled, "context", "left").select("context", share.alias("share")))
    own = rows.where("kind = 'P'").select("_id", "features", "left", "right")
    for side in ("left", "right"):
        keyed = own.withColumn("context", F.expr(f"try_cast({side} as bigint)"))
        joined = spread_join(keyed.where("context is not null"), shares, ["context"], F.xxhash64("_id"))  # a row per context
        own = joined.unionByName(keyed.where("context is null").withColumn("share", F.lit(None).cast("double"))).withColumnRenamed("share", f"{side}_share").drop("context")
    schema = T.StructType([T.StructField("_id", id_type), *[T.StructField(*x) for x in _ROW if x[0] in ("sort", "sure", "unit", "features")]])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, around, *sides in zip(b["_id"], b["features"], b["left"], b["left_share"], b["right"], b["right_share"]):
                left, right = (_bin(side if side in ("edge", "start") else share) for side, share in zip(sides[::2], sides[1::2]))
                features = _features(0, [f"left {left}", f"right {right}", f"sides {left} {right}"]) + around
                alone = left == right == "edge"
                sure = alone or {left, right} <= {"edge", "start", "mostly"}
                out.append((i, "alone" if alone else "slot", sure, _unit(features), features))
            yield pd.DataFrame(out, columns=schema.names)

    return own.mapInPandas(finish, schema)


class Weights:
    """Log-odds per feature, of residue against other text, and prior log-odds, per kind of unit (placeholder, passage).

    Both classes' feature shares are shrunk towards the share among all units, so that a feature seen in one of them only
    has bounded odds, and one seen in none has none."""

    def __init__(self, pos: np.ndarray, neg: np.ndarray):
        mass = {k: (pos[FEATURES + len(KINDS) + i], neg[FEATURES + len(KINDS) + i]) for i, k in enumerate(KINDS)}
        every = pos[:FEATURES] + neg[:FEATURES]
        self.odds = {}
        for k, (a, b) in mass.items():
            share = every / max(a + b, 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                odds = np.log((pos[:FEATURES] + SHRINK * share) / (a + SHRINK)) - np.log((neg[:FEATURES] + SHRINK * share) / (b + SHRINK))
            self.odds[k] = np.clip(np.nan_to_num(odds, nan=0.0), -MOST_ODDS, MOST_ODDS).astype(np.float32)
        self.prior = {k: float(np.log((pos[FEATURES + i] + 1) / (neg[FEATURES + i] + 1))) for i, k in enumerate(KINDS)}

    def posterior(self, sorts: pd.Series, features: pd.Series) -> np.ndarray:
        """Probability that each unit is residue, whatever label it was given."""
        at, lengths = _flat(features)
        starts = np.cumsum(lengths) - lengths
        of_kind = _kind(sorts)
        z = np.array([self.prior[k] for k in KINDS])[of_kind]
        for i, k in enumerate(KINDS):
            total = np.concatenate([[0.0], np.cumsum(self.odds[k][at], dtype=np.float64)])
            z = np.where(of_kind == i, z + total[starts + lengths] - total[starts], z)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _kind(sorts: pd.Series) -> np.ndarray:
    return sorts.map({k: i for i, k in enumerate(KINDS)}).fillna(len(KINDS) - 1).to_numpy(dtype=int)


def _flat(features: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [bytes(f) for f in features]
    return np.frombuffer(b"".join(parts), dtype=np.int32), np.fromiter((len(f) // 4 for f in parts), dtype=np.int64, count=len(parts))


_SPARSE = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
_CHANGE = -1
#: What is summed per class: each feature, then per kind its units and the features of these.
_SUMS = FEATURES + 2 * len(KINDS)


def _learn(kinds: DataFrame, max_rounds: int) -> Weights:
    """Expectation-maximization over kinds(sort, sure, unit, features, n): in fitting, trusted units stay residue, all others
    are unlabelled and count among the positives by UNLABELLED times their posterior."""
    spark = kinds.sparkSession
    before, now = None, None
    for _ in range(max_rounds):
        shared = spark.sparkContext.broadcast((before, now))

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            old, new = shared.value
            pos, neg, moved = np.zeros(_SUMS), np.zeros(_SUMS), 0.0
            for b in batches:
                sure, n, kind = b["sure"].to_numpy(dtype=bool), b["n"].to_numpy(dtype=float), _kind(b["sort"])
                p, q = (np.where(sure, 1.0, 0.0 if w is None else UNLABELLED * w.posterior(b["sort"], b["features"])) for w in (new, old))
                moved += float((np.abs(p - q) * n).sum())
                at, lengths = _flat(b["features"])
                for total, weight in ((pos, p * n), (neg, (1 - p) * n)):
                    total[:FEATURES] += np.bincount(at, weights=np.repeat(weight, lengths), minlength=FEATURES)
                    total[FEATURES : FEATURES + len(KINDS)] += np.bincount(kind, weights=weight, minlength=len(KINDS))
                    total[FEATURES + len(KINDS) :] += np.bincount(kind, weights=weight * lengths, minlength=len(KINDS))
            hit = (pos + neg).nonzero()[0]
            yield pd.DataFrame({"i": np.append(hit, _CHANGE).astype(np.int32), "a": np.append(pos[hit], moved), "b": np.append(neg[hit], 0.0)})

        got = kinds.mapInPandas(step, _SPARSE).groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()  # at most _SUMS + 1 rows
        moved = float(got.loc[got["i"] == _CHANGE, "a"].sum())
        got = got[got["i"] != _CHANGE]
        pos, neg = np.zeros(_SUMS), np.zeros(_SUMS)
        pos[got["i"]], neg[got["i"]] = got["a"], got["b"]
        before, now, first = now, Weights(pos, neg), now is None
        if not first and moved <= TOLERANCE * max(1.0, pos[FEATURES : FEATURES + len(KINDS)].sum()):
            return now
    raise RuntimeError(f"expectation-maximization has not settled after {max_rounds} rounds")


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Documents with residue: id_col, sort (placeholder, filler, error, script, or passage where no wording names the
    sort), score (highest posterior of a unit), n_units (residue units).

    Units are placeholders with their sides and the words around them, and passages (sentences) with their words. Code,
    quotations and paths are not looked at; log lines only for placeholders. Trusted records, for fitting only, are
    placeholders that stand alone, after a field label, or between contexts that are mostly filled in elsewhere, and
    passages with a trusted wording; everything else is unlabelled. Naive Bayes is learned from both by
    expectation-maximization until it settles (an error after ``max_rounds``), then scores every unit, trusted or not; a
    document is residue if any of its units has a posterior above one half.

    Null, empty and blank texts give no row, repeated rows one. Statistics come from all documents: contexts of
    placeholders are counted exactly, as a share of their own occurrences, which does not depend on the size of the corpus;
    features are hashed into a table of fixed size; units that look alike are counted before learning.
    """
    src = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.length(F.trim("text")) > 0))
    spark, id_type = docs.sparkSession, src.schema["_id"].dataType
    asked = cut(_asked(src))
    rows = cut(_parsed(src, spark.sparkContext.broadcast(_filter(asked)), id_type))
    unit = ["_id", "sort", "sure", "unit", "features"]
    found = rows.where("kind = 'T'").select(*unit).unionByName(cut(_placeholders(rows, asked, id_type)).select(*unit))
    kinds = cut(found.groupBy("sort", "sure", "unit").agg(F.first("features", ignorenulls=True).alias("features"), F.count(F.lit(1)).alias("n")))
    weights = spark.sparkContext.broadcast(_learn(kinds, max_rounds))

    @F.pandas_udf(T.DoubleType())
    def posterior(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sorts, features in batches:
            yield pd.Series(weights.value.posterior(sorts, features), dtype="float64")

    residue = kinds.withColumn("score", posterior("sort", "features")).where("score > 0.5").select("sort", "sure", "unit", "score")
    hits = spread_join(found.drop("features"), residue, ["sort", "sure", "unit"], F.xxhash64("_id"))
    hits = hits.withColumn("sort", F.when(F.col("sort").isin("alone", "slot"), "placeholder").otherwise(F.col("sort")))
    best = F.max(F.struct("score", "sort")).alias("b")
    return hits.groupBy("_id").agg(best, F.count(F.lit(1)).alias("n_units")).select(F.col("_id").alias(id_col), "b.sort", "b.score", "n_units")


def without_residue(docs: DataFrame, residue: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus without the documents found."""
    return docs.join(residue.select(id_col), id_col, "left_anti")
