"""Problem 4: defective pairs of request and reply.

Shortened versions are found by sorting: texts in order are compared with their
neighbours, and one that is a proper prefix of the next is shortened.  Two lists
are sorted.  In the list of distinct bodies, what follows in the longer one tells
whether a body stops inside a sentence, also behind a dot.  As hardly any reply
has its own longer version among the others, the second list holds the last
words of every unfinished body, or the last signs of cut JSON, among the word
sequences of all replies: an ending that other replies go on from is shortened,
one that nothing goes on from is not.  Lengths at which far more unfinished
bodies end than at the lengths around them are limits of the writer.  Rules for
empty, copied, refusing and foreign replies name the other defects.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut
from .conversations import kept_rows
from .langid import LanguageModel

_UNSPACED = "一-鿿㐀-䶿぀-ヿ฀-๿"
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_ENDS = ".!?…。！？।"
_CLOSE = "\"'”’»“」』)）]` \t\r\n\xa0 *_"
_FILE = r"[\w\-./\\]*\w\.[A-Za-z0-9]{1,5}"
_BARE = re.compile(rf"^(?:{_FILE}|[pP]?\d+)(?:[,;、，]?\s*(?:{_FILE}|[pP]?\d+))*[.。]?$")
_SENTENCE = re.compile(r"(?<=[!?。！？])\s*|(?<=[.!?][\"”’»)])\s+|(?<=[.])\s+(?=[^\sa-zа-я])|\n+")
#: Cues of a refusal: the writer declines, may not, won't or sends away; by language.
REFUSAL = re.compile(
    "|".join(
        (
            # English
            r"(?:can't|cannot|can not|unable to|not able to) (?:help|assist|answer|describe|discuss|comment|do that|share|continue|provide)", r"\bi won't\b", r"\bi will not\b", r"\bdeclin", r"have to pass\b", r"rather not\b", r"off limits", r"\bno comment\b",
            r"not a task i\b", r"inappropriate for me", r"not (?:something i am )?comfortable", r"do(?:n't| not) comment", r"outside what i\b", r"keep me from", r"\bi am not (?:allowed|permitted)", r"against my (?:guidelines|rules|instructions|policy)", r"ask (?:somebody|someone) else", r"\brefuse\b", r"must not (?:describe|answer|discuss)",
            # German
            r"keine auskunft", r"ablehnen", r"nicht (?:weiter)?helfen", r"äußere ich mich nicht", r"ich möchte (?:\S+ ){0,5}nicht", r"widerspricht meinen", r"möchte ich (?:\w+ ){0,4}(?:lieber )?nicht", r"darf ich (?:\S+ ){0,6}nicht", r"ist mir (?:\S+ ){0,3}(?:nicht erlaubt|untersagt|verboten)", r"gegen meine (?:richtlinien|regeln|vorgaben)", r"(?:verbieten|untersagen) (?:es )?mir", r"fragen sie bitte (?:jemand|wen) ander", r"an jemand(?:en)? ander", r"sage ich (?:\S+ ){0,4}nichts", r"lieber nicht", r"kein kommentar", r"hindern mich", r"über etwas anderes",
            # French
            r"m'est interdit", r"je ne (?:peux|puis) pas (?:vous )?(?:aider|répondre|décrire|commenter|en parler)", r"je (?:dois|préfère) (?:\S+ ){0,3}(?:refuser|décliner|passer|ne (?:pas|rien))", r"m'empêchent", r"(?:adressez-vous|demandez)[^.]*quelqu'un d'autre", r"pas (?:autorisé|permis)", r"décline", r"(?:pas de|aucun|sans) commentaire", r"je ne (?:commente|décri|parle|dirai|commenterai|traite)", r"contraire à mes", r"contre mes (?:règles|consignes)", r"refuse", r"parlons d'autre chose", r"ne souhaite pas", r"m'abstien", r"je ne suis pas en mesure",
            # Spanish
            r"rechazar", r"no (?:puedo|debo) (?:ayudar|responder|describir|comentar|hablar|contestar|dar)", r"no hago comentarios", r"prefiero no", r"no (?:me está|se me) permit", r"no estoy autorizad", r"no voy a", r"mis (?:normas|reglas|instrucciones) (?:me |no )", r"otra persona", r"contra mis", r"declin", r"sin comentarios", r"no me corresponde", r"me niego", r"hablemos de otra cosa", r"me impiden", r"me prohíbe", r"no comento",
            # Russian
            r"отклонить", r"отказ", r"не (?:разрешено|позволено|положено)", r"не (?:могу|имею права|стану|буду|вправе|хочу) ?(?:\S+ ){0,3}(?:помочь|помогать|комментировать|описывать|отвечать|ответить|говорить|рассказывать|обсуждать|разбирать|открывать)", r"против моих", r"обратитесь", r"без комментариев", r"воздерж", r"запрещ", r"не даю комментариев", r"предпоч\S+ не", r"поговорим о (?:чём|чем)-нибудь", r"мешают мне", r"не позволяют", r"не комментирую", r"ничем не",
            # Chinese
            r"不便", r"拒绝", r"帮不上", r"另请高明", r"无法(?:描述|回答|评论|提供|帮|说明|分析|处理|协助|讨论)", r"不允许", r"不能(?:评论|回答|描述|帮|提供|说明|讨论|透露|分析)", r"不予", r"恕(?:我|不)", r"不想(?:谈|说|评论|描述)", r"换个话题", r"不(?:作|做|加)评论", r"没法(?:帮|回答|描述)", r"不宜",
        )
    )
)
#: The words of a reply within JSON that may be cut; the last value may lack its end.
_FIELD = re.compile(r'"(?:summary|memo|text|answer)"\s*:\s*"((?:[^"\\]|\\.)*)', re.S)
_VALUE = re.compile(r'"(?:[^"\\]|\\.)*"(?!\s*:)(?=\s*[,}\]])', re.S)
#: Words of a shortened ending, and how much longer the sequences are that it is compared with.
ENDING, MORE = 2, 1
#: Dots that end no sentence by themselves: initials and letters of abbreviations, words before numbers, ordinals behind an article.
_INNER_DOT = re.compile(r"(?:^|[\s(\[\"'“„«.])(?:[^\W\d_]|nr|no|núm|vol|abb|bzw|ca|vgl|fig|dr|mr|mrs|prof|sr|sra|стр|рис|(?:am|vom|zum|der|dem|den|des|im|bis) \d{1,2})\.$", re.I)
_SORRY = re.compile(r"^(?:i(?:'m| am) (?:very )?sorry|sorry|thank you[^.]*|unfortunately|tut mir leid|leider|entschuldigung|désolé|pardon|lo siento|disculpe|извините|простите|к сожалению|很?抱歉|对不起)[\s,.!，。！]*$", re.I)


def unwrap(text: str | None) -> tuple[str, str]:
    """(form, body): the words of a reply without code fence and JSON; form is empty, action, broken or text."""
    t = (text or "").strip()
    prefix = ""
    fence = re.match(r"^`{3,}[a-z]*\s*(.*?)\s*(?:`{3,})?$", t, re.S)
    if fence:
        t = fence.group(1).strip()
    if not re.sub(r"[\s\"'`“”«»\[\]{}]+", "", t) or t.lower() in ("null", "none", "json"):
        return "empty", ""
    at = t.find("{")
    if at > 0 and re.match(r'\{\s*"', t[at:]):
        prefix, t = t[:at].rstrip("` \n").removesuffix("json").rstrip("` \n"), t[at:].rstrip("` \n")
    if t.startswith("{") or t.startswith('"') and t.endswith('"') and len(t) > 1:
        try:
            value = json.loads(t, strict=False)
        except ValueError:
            return ("broken", _cut_words(t)) if t.startswith("{") else ("text", t)
        if isinstance(value, str):
            return ("text", value) if value.strip() else ("empty", "")
        if isinstance(value, dict):
            parts = [value.get("summary"), value.get("memo"), value.get("text"), value.get("answer")]
            if isinstance(value.get("identity"), dict):
                parts.append(value["identity"].get("summary"))
            words = "\n".join(p for p in parts if isinstance(p, str) and p.strip())
            action = value.get("action")
            if not words and not (isinstance(action, str) and action.strip()):
                return "empty", ""
            return ("text", words) if words else ("action", "")
    return "text", (prefix + "\n" + t if prefix else t)


def frame(reply: str | None) -> str:
    """The signs and keys of a reply's JSON without its values; an unfinished string is a single quotation mark."""
    t = reply or ""
    at = t.find("{")
    if at < 0 or not re.match(r'\{\s*"', t[at:]):
        return ""
    t = _VALUE.sub('"v"', t[at:].rstrip("` \n"))
    if t.count('"') % 2:
        t = t[: t.rindex('"') + 1]
    return re.sub(r"([{}\[\],:])", r" \1 ", t)


def _cut_words(t: str) -> str:
    """The words of a JSON object that doesn't parse, as far as they go."""
    words = []
    for value in _FIELD.findall(t):
        try:
            words.append(json.loads(f'"{value}"', strict=False))
        except ValueError:  # cut within an escape
            words.append(value)
    return "\n".join(w for w in words if w.strip())


def own_wording(request: str) -> str:
    """What the writer of a request worded: its lines before the material it delivers."""
    return request.split("\n", 1)[0]


def tokens(text: str) -> list[str]:
    return _WORDS.findall(text.casefold())


def is_copy(body: str, request: str) -> bool:
    """Whether all words of the body stand in the request, in runs, and are the request's wording or most of its page."""
    b = tokens(body)
    if not b:
        return False
    low = request.casefold()
    if sum(t not in low for t in b) > 0.1 * len(b):  # then less than nine in ten can be covered
        return False
    page = request.split("\n\n", 1)[1] if "\n\n" in request else request.split("\n", 1)[-1]
    n = min(4, len(b))
    own = [tuple(b[i : i + n]) for i in range(len(b) - n + 1)]
    grams = set(own)
    for whole, least in ((request, 0.8), (page, 0.5), (own_wording(request), 0.9)):
        w = tokens(whole)
        if len(w) < n:
            continue
        theirs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        known, covered = set(theirs), set()
        for i, g in enumerate(own):
            if g in known:
                covered.update(range(i, i + n))
        if len(covered) >= 0.9 * len(b) and sum(g in grams for g in theirs) >= least * len(theirs):
            return True
    return False


def is_refusal(body: str) -> bool:
    """Every sentence declines (or only says sorry); one that answers makes the reply no refusal."""
    declines = False
    for part in _SENTENCE.split(body.strip()):
        if part and _WORDS.search(part):
            plain = part.lower().replace("’", "'")
            if REFUSAL.search(plain):
                declines = True
            elif not _SORRY.match(part.strip()):
                return False  # most replies answer in their first sentence
    return declines


def breaks_off(body: str) -> bool:
    """Whether a body stops inside a sentence; bare file names and page numbers are complete."""
    bare = body.rstrip(_CLOSE)
    if not bare or _BARE.match(body.strip().strip(_CLOSE)):
        return False
    if re.search(r"(?<![.…])(?:\.{3}|…)$", bare) and not re.search(r"[.!?。！？]\s*(?:\.{3}|…)$", bare):
        return True  # cut with an ellipsis; the doubled one ends sentences in Chinese
    return bare[-1] not in _ENDS and not "฀" <= bare[-1] <= "๿"


def stops_inside(body: str, rest: str) -> bool:
    """Whether a body whose longer version goes on with ``rest`` stops inside a sentence, also behind a dot."""
    bare, goes_on = body.rstrip(_CLOSE), rest.lstrip()
    if not bare or not goes_on or "\n" in body[len(bare) :] + rest[: len(rest) - len(goes_on)]:
        return breaks_off(body)
    if "฀" <= bare[-1] <= "๿":
        return body == bare and rest == goes_on  # a space between Thai letters ends a sentence
    if bare[-1] not in _ENDS:
        return breaks_off(body)
    if bare[-1] != "." or bare.endswith(".."):
        return False
    if body == bare and rest == goes_on and goes_on[0].isalnum():
        return True  # 3.5, z.B., notes.txt
    return goes_on[0].islower() or inner_dot(body)


def inner_dot(body: str) -> bool:
    """Whether a body ends in a dot that ends no sentence by itself."""
    return bool(_INNER_DOT.search(body.rstrip()[-40:]))


def _near(messages: DataFrame) -> DataFrame:
    """Replies of kept conversations with ``near``, the nearest user row before in the same block of turns."""
    rows = kept_rows(messages)
    near = F.last(_user(), ignorenulls=True).over(W.partitionBy("run_id", "session", "block").orderBy("turn"))
    return rows.withColumn("near", near).filter("speaker = 'assistant'")


def _user() -> Column:
    return F.when(F.col("speaker") == "user", F.struct(F.coalesce("text", F.lit("")).alias("text")))


def _pairs(messages: DataFrame) -> DataFrame:
    """(run_id, msg_id, reply, request, late): ``late`` replies stand ahead of their block's first request; see :func:`_late_pairs`."""
    near = _near(messages).filter("near is not null or many")
    return near.select("run_id", "msg_id", F.col("text").alias("reply"), F.col("near.text").alias("request"), F.col("near").isNull().alias("late"))


def _late_pairs(messages: DataFrame) -> DataFrame:
    """(run_id, msg_id, reply, request) of late replies: the last request of the blocks before is carried on.

    Only conversations of several blocks have any; a window over the blocks of one is a thousandth of its rows.
    """
    keys = ["run_id", "session", "block"]
    lasts = kept_rows(messages).filter("many").groupBy(*keys).agg(F.max_by(_user(), F.when(F.col("speaker") == "user", F.col("turn"))).alias("last"))
    before = W.partitionBy("run_id", "session").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.last("last", ignorenulls=True).over(before).alias("far"))
    same = F.col("run_id").eqNullSafe(F.col("__run_id")) & F.col("session").eqNullSafe(F.col("__session")) & (F.col("block") == F.col("__block"))
    late = _near(messages).filter("near is null and many").join(carried, same).filter("far is not null")
    return late.select("run_id", "msg_id", F.col("text").alias("reply"), F.col("far.text").alias("request"))


def run_languages(messages: DataFrame, languages: tuple) -> DataFrame:
    """(run_id, asked): the language a run's requests are worded in, by their own wording only."""
    shared = messages.sparkSession.sparkContext.broadcast(languages)

    def ask(cols: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, seen = LanguageModel(*shared.value), {}
        for col in cols:
            out = []
            for t in col:
                line = re.sub(r"\S*[\d/\\_]\S*", " ", own_wording(t or ""))
                if line not in seen:
                    lang, sure = known.best(line)
                    seen[line] = lang if sure > 0.8 else None
                out.append(seen[line])
            yield pd.Series(out, dtype=object)

    lang = F.pandas_udf(ask, "string")(F.col("text"))
    asked = messages.filter(F.lower(F.trim("role")).isin("user", "system")).select("run_id", lang.alias("asked")).filter("asked is not null")
    counts = asked.groupBy("run_id", "asked").agg(F.count("*").alias("n"))
    return counts.groupBy("run_id").agg(F.max_by("asked", F.struct("n", "asked")).alias("asked"))


def shortened(bodies: DataFrame) -> DataFrame:
    """(h, longer, inside): hashes of distinct bodies; ``longer`` tells a proper prefix of the next one in text order,
    ``inside`` one that the next shows to stop inside a sentence.

    Range partitions keep neighbours together and are read in order; one row per partition carries its first and last
    body, with which the last of each is judged.
    """
    n = max(2, int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = bodies.filter("body <> ''").distinct().repartitionByRange(n, "body").sortWithinPartitions("body").select(F.xxhash64("body").alias("h"), "body")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for b in batches:
            rows = []
            for h, body in zip(b["h"], b["body"]):
                if last is None:
                    first = body
                else:
                    rows.append((last[0], *_shown(last[1], body), None, None, None))
                last = (h, body)
            yield pd.DataFrame(rows, columns=["h", "longer", "inside", "part", "first", "last"])
        if last:
            yield pd.DataFrame([(last[0], False, False, part, first, last[1])], columns=["h", "longer", "inside", "part", "first", "last"])

    found = cut(placed.mapInPandas(compare, "h long, longer boolean, inside boolean, part long, first string, last string"))
    edges = found.filter("part is not null").orderBy("part").collect()  # one row per partition
    shown = [(a["h"], *_shown(a["last"], b["first"])) for a, b in zip(edges, edges[1:])]
    late = {"longer": [h for h, longer, _ in shown if longer], "inside": [h for h, _, inside in shown if inside]}
    return found.select("h", *[(F.col(c) | F.col("h").isin(hs) if hs else F.col(c)).alias(c) for c, hs in late.items()])


def _prefix(short: str, long: str) -> bool:
    return long != short and long.startswith(short)


def _shown(short: str, long: str) -> tuple[bool, bool]:
    longer = _prefix(short, long)
    return longer, longer and stops_inside(short, long[len(short) :])


def _sequence(text: Column) -> Column:
    """Words of a text; file names and numbers are alike, characters of unspaced scripts are words of their own."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\S*\w\.[A-Za-z]\w{1,4}\b", "f"), r"\d+(?:[.,:/\-]\d+)*", "0")
    return F.filter(F.split(F.regexp_replace(plain, f"([{_UNSPACED}])", " $1 "), r"\s+"), lambda w: w != "")


def shortened_endings(bodies: DataFrame, unfinished: DataFrame) -> DataFrame:
    """(body): the unfinished texts whose last words finished ones go on from.

    ``bodies``, the finished ones, and ``unfinished`` have one column ``body``.  The last ENDING words, or those before the last, which may be
    cut, are sorted among all sequences of ENDING + MORE words; see :func:`shortened`.
    """
    words = _sequence(F.col("body"))
    some = bodies.filter("body <> ''").distinct().withColumn("w", words).filter(F.size("w") > 0)
    runs = some.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, ENDING + MORE), " "))).alias("body"))
    bare = F.regexp_replace("body", r"(?:\.{2,}|…)[\"”’»)\s]*$", "")
    last = lambda back: F.array_join(F.slice(F.reverse(F.slice(F.reverse("w"), back + 1, ENDING)), 1, ENDING), " ")
    ends = cut(unfinished.filter("body <> ''").distinct().withColumn("w", _sequence(bare)).filter(F.size("w") > 0).select("body", F.explode(F.array_distinct(F.array(last(0), last(1)))).alias("end")).filter("end <> ''"))
    longer = shortened(runs.unionByName(ends.select(F.col("end").alias("body")))).filter("longer").select("h").distinct()
    return ends.join(longer, F.xxhash64("end") == F.col("h"), "left_semi").select("body").distinct()


def length_limits(bodies: DataFrame) -> DataFrame:
    """(size): lengths at which more unfinished bodies end than at all twenty lengths around them together."""
    unfinished = bodies.filter(~F.regexp_replace("body", r"[\s\"'”’»)\]`]+$", "").rlike(f"[{_ENDS}]$")).groupBy(F.length("body").alias("size")).agg(F.count("*").alias("n"))
    around = unfinished.withColumn("near", F.explode(F.sequence(F.col("size") - 10, F.col("size") + 10))).groupBy("near").agg(F.sum("n").alias("window"))
    return unfinished.join(around, unfinished["size"] == around["near"]).filter("n > 10 and 2 * n > window").select("size")


def find_defects(messages: DataFrame, languages: tuple) -> DataFrame:
    """(msg_id, defect) of the defective replies: empty, copy, refusal, truncated or other_language, the first that holds.

    Conversations to drop give none.  Null requests count as empty wording; a reply without a user row before it forms
    no pair; repeated arrivals count once.  Texts are judged where the pair is made; only verdicts are joined on.
    """
    shared = messages.sparkSession.sparkContext.broadcast(languages)

    def judge(cols: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = LanguageModel(*shared.value)
        for replies, requests in cols:
            yield pd.DataFrame([_judge(a, b or "", known) for a, b in zip(replies, requests)], columns=["body", "verdict", "open", "lang", "ending", "frame"])

    verdict = F.pandas_udf(judge, "body string, verdict string, open boolean, lang string, ending string, frame string")("reply", "request")
    cols = ["run_id", "msg_id", "p.*"]
    pairs = cut(_pairs(messages).withColumn("p", verdict).select(*cols, "late"))
    if pairs.filter("late").limit(1).count():
        late = cut(_late_pairs(messages).withColumn("p", verdict).select(*cols))
        pairs = pairs.filter("not late").drop("late").unionByName(late)
    pairs = pairs.withColumn("h", F.xxhash64("body")).withColumn("e", F.xxhash64("ending")).withColumn("size", F.length("body"))
    texts = pairs.select("body").filter("body <> ''")
    longer = shortened(texts).filter("inside").select("h", "inside")
    endings = shortened_endings(pairs.filter("ending = ''").select(F.explode(F.array("body", "frame")).alias("body")), pairs.select(F.col("ending").alias("body"))).select(F.xxhash64("body").alias("e"), F.lit(True).alias("goes_on"))
    limits = length_limits(texts).select(F.col("size"), F.lit(True).alias("limited"))
    slim = pairs.select("run_id", "msg_id", "verdict", "open", "lang", "h", "e", "size", (F.col("ending") != "").alias("unfinished"))
    joined = slim.join(longer, "h", "left").join(endings, "e", "left").join(limits, "size", "left").join(run_languages(messages, languages), "run_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    shorter = yes(F.col("inside")) | yes(F.col("limited")) & (F.col("open") | F.col("unfinished")) | yes(F.col("goes_on")) & F.col("unfinished")
    foreign = F.col("lang").isNotNull() & F.col("asked").isNotNull() & (F.col("lang") != F.col("asked"))
    defect = F.when(F.col("verdict") != "", F.col("verdict")).when(shorter, F.lit("truncated")).when(foreign, F.lit("other_language"))
    return joined.select("msg_id", defect.alias("defect")).filter("defect is not null").distinct()


def _judge(reply: str | None, request: str, known: LanguageModel) -> tuple[str, str, bool, str | None, str, str]:
    """(body, verdict or '', whether the body stops without an end that is sure, its language if sure, its unfinished
    text or '', the frame of its JSON)."""
    form, body = unwrap(reply)
    if form == "empty":
        return "", "empty", False, None, "", ""
    signs = frame(reply)
    if form != "text":
        return body, "", False, None, signs or body if form == "broken" else "", "" if form == "broken" else signs
    if is_copy(body, request):
        return body, "copy", False, None, "", signs
    if is_refusal(body):
        return body, "refusal", False, None, "", signs
    if breaks_off(body):
        return body, "", True, None, body, signs
    if _BARE.match(body.strip()):
        return body, "", False, None, "", signs
    got, sure = known.best(body)
    return body, "", body.rstrip(_CLOSE)[-1:] not in _ENDS or inner_dot(body), got if sure > 0.9 else None, "", signs
