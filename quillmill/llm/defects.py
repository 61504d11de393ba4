"""Problem 5: broken prompt and response pairs.

A suffix automaton of the prompt's tokens measures how much of a response is copied; an Aho-Corasick automaton of
refusal phrases, delimiter stacks (with the prefix evidence of problem 6) and votes of stop words by language find the
other defects. Lists of terms have no stop words: there the words vote that sentences told by stop words hold, and the
character n-grams of these words.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .terms import clean_terms
from .truncation import truncated_values

# fixed values: mere placeholders
PLACEHOLDERS = frozenset(
    "none null nil nan na n/a n.a. tbd todo tba unknown undefined empty (empty) (none) (null) placeholder [placeholder] "
    "<empty> <none> <null> lorem ipsum xxx x ? ?? ??? - -- --- . .. ... … _ __ [] {} () \"\" '' <think></think> <think> "
    "#n/a [none] [null] blank".split()
) | {"no answer", "not available", "lorem ipsum", "to be defined", "to do", "(no value)"}

# fixed values: parts of the phrases by which a model declines; each row of DECLINES is combined to all its phrases
TASKS = (
    "answer assist carry comment complete comply continue create describe determine discuss do draft draw engage fulfil "
    "fulfill generate give go help identify infer make offer perform predict proceed process produce provide recommend respond "
    "say select share suggest summarise summarize supply support tell translate write"
).split()
UNABLE = (
    "cannot", "can't", "can not", "could not", "couldn't", "am unable to", "am not able to", "am not allowed to", "am not permitted to", "am not in a position to",
    "will not", "won't", "will not be able to", "won't be able to", "must decline to", "have to decline to", "decline to", "refuse to", "must refuse to", "have to refuse to",
)
DECLINES = (
    (("i", "we"), UNABLE, TASKS),
    (("i'm", "we're", "we are"), ("unable to", "not able to", "not allowed to", "not permitted to", "not in a position to"), TASKS),
    (("it is", "it's"), ("not possible", "impossible"), ("for me to", "for us to"), TASKS),
    (("not permitted to", "not allowed to", "not authorised to", "not authorized to"), TASKS),
    (("i", "we"), ("must", "have to", "need to", "would like to"), ("decline", "respectfully decline", "politely decline", "refuse")),
    (("request", "query", "prompt", "task", "question"), ("", "is", "was", "has been", "must be", "had to be"), ("declined", "denied", "refused", "rejected")),
    (("no",), ("answer", "response", "output", "result", "instruction", "recommendation", "prediction", "completion"),
     ("is possible", "is available", "can be given", "can be provided", "can be generated", "can be made", "could be generated", "could be produced", "will be given")),
    (("this is", "that is", "that's", "it is", "this isn't", "that isn't"), ("not something", "something"), ("i can", "i can't", "i cannot", "i am able to", "i am allowed to", "i'm able to")),
    (("beyond what i", "outside what i", "more than i"), ("can", "can do", "am able", "am allowed", "am permitted")),
    (("beyond my", "outside my", "outside of my"), ("abilities", "capabilities", "capability", "remit", "scope")),
    (("violate", "violates", "breach", "breaches", "against", "contrary to", "under"), ("my", "our", "the content", "the usage", "the safety", "the current", "content", "usage", "safety"), ("policy", "policies", "guideline", "guidelines")),
    (("as an ai", "as a language model", "as a large language model", "as an artificial intelligence", "i am just an ai", "i'm just an ai"),),
    (("i'm sorry", "i am sorry", "sorry", "my apologies", "i apologise", "i apologize", "apologies"), (", but i", ", i", ", but this", ", this is not", ", but that", ", that is not", ", but we", ", but it is")),
    (("kann ich", "kann ich dir", "kann ich ihnen", "kann dabei", "kann dir dabei", "kann ihnen dabei", "kann hier", "darf ich"), ("nicht helfen", "nicht weiterhelfen", "nicht antworten", "nicht beantworten")),
    (("tut mir leid, aber", "leider kann ich", "ich kann leider", "ich muss ablehnen"),),
    (("je ne peux pas", "je ne suis pas en mesure de", "je ne suis pas en mesure d'", "il m'est impossible de", "il m'est impossible d'"), ("", "vous", "te", "t'"), ("aider", "répondre", "générer", "fournir", "faire")),
    (("je suis désolé", "désolé, mais", "désolée, mais", "je regrette, mais"),),
    (("no puedo", "no podemos", "no me es posible", "no es posible"), ("ayudar", "ayudarte", "ayudarle", "responder", "generar", "proporcionar", "hacer")),
    (("lo siento, pero", "lo lamento, pero"),),
    (("non posso", "non sono in grado di", "non mi è possibile"), ("aiutare", "aiutarti", "aiutarla", "rispondere", "generare", "fornire", "fare")),
    (("mi dispiace, ma", "sono spiacente, ma"),),
    (("não posso", "não consigo"), ("ajudar", "responder", "gerar", "fornecer", "fazer")),
    (("desculpe, mas", "sinto muito, mas", "lamento, mas"),),
    (("het spijt me, maar", "ik kan hier niet", "ik kan je hier niet", "ik kan u hier niet"),),
    (("抱歉", "对不起", "我无法", "我不能", "申し訳", "お手伝いできません", "죄송합니다"),),
)
#: Without a subject only at the begin of a sentence or of a list's element ('Cannot determine the terms').
BARE = (("cannot", "can't", "can not", "could not", "unable to", "not able to", "impossible to", "not possible to"), TASKS)

# fixed values: the most frequent function words of each language; a word of several languages counts as a fraction for each
STOPWORDS = {
    "en": "the of and to a in is it you that he was for on are with as i his they be at one have this from or had by not but what we when your can said there an each which she do how their if will up about out many then them these so some her would make like him into has more no than been its who now my over did down only way may should am me any could does where before after through just because very too here such those being both between under".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir mir mich dich du kann wenn schon alles damit ihr seine eines keine weil bitte soll".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son si mais nous sa aux ont je cette elle vous ses comme tout même bien sans peut y on deux leur tu être mon ma très car où l d lui dont fait puis".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien cada ese esa esto".split(),
    "it": "di e il la che in un a per è una sono con non si le da lo i del della al ha come dei più su nel alla anche ma delle o se gli ci mi io ho questo questa dal nella essere tra era due suo sua molto loro dalla sulla sul cui perché fra uno quando ogni senza tutto dopo po tutti già noi lui lei".split(),
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles você essa num nem suas meu minha têm".split(),
    "nl": "de van een het en in is dat op te zijn met voor niet die aan er om ook als dan maar bij nog uit naar door over ze zich wel heeft hij of geen werd wordt deze dit veel tot kan meer haar zou hebben ik je mijn wat we al worden onder moet had mij daar hier goed na omdat zonder".split(),
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words):
        _VOTES.setdefault(_w, []).append(_lang)


class SuffixAutomaton:
    """All substrings of a token sequence; built online, one state per new token at most twice."""

    def __init__(self, tokens: list):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for t in tokens:
            cur = self._state(self.size[last] + 1)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][t]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.size[p] + 1)
                    self.next[clone] = dict(self.next[q])
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.next) - 1

    def covered(self, tokens: list, words: int, alone) -> list[bool]:
        """Which tokens lie in a run that also occurs here and that has ``words`` tokens or one with ``alone(token)``.

        One pass for the runs (their tokens that stand alone are counted as prefix sums), one for the marks.
        """
        n = len(tokens)
        singles = [0] * (n + 1)
        reach = [0] * (n + 1)  # opened minus closed marks
        state = length = 0
        for i, t in enumerate(tokens):
            singles[i + 1] = singles[i] + bool(alone(t))
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            else:
                length = 0
            if length and (length >= words or singles[i + 1] > singles[i + 1 - length]):
                reach[i + 1 - length] += 1
                reach[i + 1] -= 1
        out, depth = [], 0
        for d in reach[:n]:
            depth += d
            out.append(depth > 0)
        return out


_TOKEN = re.compile(r"<s_a_\d+>\s*<s_b_\d+>\s*<s_c_\d+>|[^\W_]+(?:[-'’][^\W_]+)*")


_SPACE = re.compile(r"\s+")
_MARKER = re.compile(r"<\|cid_(?:begin|end)\|>")


def tokens_of(text: str) -> list[str]:
    """Item codes without blanks, and words, in lower case."""
    if "<" not in text:
        return _TOKEN.findall(text.lower())
    return [_SPACE.sub("", t) if t[0] == "<" else t for t in _TOKEN.findall(_MARKER.sub(" ", text).lower())]


class Source:
    """What may have been copied; its automaton is built when a value holds enough of its tokens at all."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.known, self.automaton = tokens, set(tokens), None

    def share(self, value: list[str], words: int, least: float) -> bool:
        """Whether runs of the source hold ``least`` of the value's characters: item codes alone, words from ``words`` in a row."""
        value = [t for t in value if not t.isdigit()]
        total = sum(map(len, value))
        if not total or sum(len(t) for t in value if t in self.known) < least * total:
            return False
        if self.automaton is None:
            self.automaton = SuffixAutomaton(self.tokens)
        got = self.automaton.covered(value, words, lambda t: t[0] == "<")
        return sum(len(t) for t, c in zip(value, got) if c) >= least * total


_LABEL = re.compile(r"^\s*\w[\w ]{0,20}:\s+")  # "Terms: ", "target_tid: "
_LEAD = re.compile(r"^\s*[A-Za-z][^:.!?\n]{0,25}:\s+")  # "OK, here it is: "
_FOREIGN_SCRIPT = re.compile(r"[Ѐ-ԯ֐-ۿऀ-෿฀-໿ᄀ-ᇿ぀-ヿ㐀-鿿가-힯]")


_WORDS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[äöüßáéíóúñàèìòùâêîôûçãõ¿¡]")
_TORN_WORD = re.compile(r"(?<=\s)\w+[^\w.!?。！？]*\Z")  # a last word without a stop may be part of one
_STOP = re.compile(r"(?<=[.!?。！？])\s*")


def votes_of(sentence: str) -> dict[str, float]:
    """Votes of the stop words of a sentence in lower case, by language."""
    votes: dict[str, float] = {}
    for w in filter(_VOTES.__contains__, _WORDS.findall(sentence)):
        langs = _VOTES[w]
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + 1 / len(langs)
    return votes


def foreign_share(text: str) -> float:
    """Share of the voting characters that lie in sentences whose stop words or script are not English."""
    plain = _LEAD.sub("", text).lower()
    if "<" in plain:
        plain = re.sub(r"<[^>]*>?", " ", plain)
    foreign = total = 0
    for s in _STOP.split(plain):
        letters = sum(map(str.isalpha, s))
        if not s.isascii():
            script = len(_FOREIGN_SCRIPT.findall(s))
            if script * 2 > letters and script:
                foreign, total = foreign + 3 * script, total + 3 * letters  # a CJK character is about three Latin ones
                continue
        votes = votes_of(_TORN_WORD.sub("", s))
        marks = 0 if s.isascii() else len(_MARKS.findall(s))
        marks = marks if marks > 1 else 0  # one is in many a loan word
        best = max((v for k, v in votes.items() if k != "en"), default=0)
        if not best and not votes.get("en") and not marks:
            continue
        total += letters
        if best + 0.25 * marks > votes.get("en", 0):
            foreign += letters
    return foreign / total if total else 0.0


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    s = re.sub(r"[\s​‌‍﻿ ]+", " ", text).strip().lower()
    return not s or s in PLACEHOLDERS or s.strip("\"'[](){}<>.,:;- ") in ("", "none", "null", "nan", "n/a", "tbd", "todo", "empty", "placeholder")


def _refusals():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for row in DECLINES:
        for parts in itertools.product(*row):
            p = re.sub(r" +(?=,)", "", " ".join(x for x in parts if x))
            machine.add_word(p, (p, False))
    for parts in itertools.product(*BARE):
        p = " ".join(parts)
        if p not in machine:
            machine.add_word(p, (p, True))
    machine.make_automaton()
    return machine


def _declines(machine, text: str) -> bool:
    s = re.sub(r"\s+", " ", text.lower().replace("’", "'"))
    for end, (phrase, bare) in machine.iter(s):
        begin = end - len(phrase) + 1
        if begin and phrase[0].isascii() and s[begin - 1].isalnum():
            continue
        if end + 1 < len(s) and phrase[-1].isascii() and s[end + 1].isalpha():
            continue
        if bare and not re.search(r"(^|[.!?:;,\n\"'(\[])\s*\Z", s[max(0, begin - 3) : begin]):
            continue
        return True
    return False


_DEFECT_SCHEMA = "row_id long, field string, defect string"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    machine = _refusals()
    for pdf in batches:
        out: list[tuple] = []
        for row_id, hist, tid, ins, why in zip(pdf["row_id"], pdf["hist_sid"], pdf["target_tid"], pdf["target_ins"], pdf["reasoning"]):
            terms = [t for t in (tid if tid is not None else ()) if t is not None and not is_empty(t)]
            if not terms:
                out.append((row_id, "target_tid", "empty"))
            else:
                codes = sum("<s_a_" in t or "<|cid_" in t for t in terms)
                if 2 * codes > len(terms):
                    out.append((row_id, "target_tid", "copy"))
                declines = _declines(machine, ", ".join(terms)) or _declines(machine, " ".join(terms))
                if declines:
                    out.append((row_id, "target_tid", "refusal"))
                if declines and foreign_share(" ".join(terms)) > 0.5:
                    out.append((row_id, "target_tid", "language"))
                elif foreign_share(". ".join(terms)) > 0.5 and sum(bool(_FOREIGN_SCRIPT.search(t)) for t in terms) * 2 > len(terms):
                    out.append((row_id, "target_tid", "language"))
            if is_empty(ins):
                out.append((row_id, "target_ins", "empty"))
            prompt = Source(tokens_of(" ".join(x for x in (hist if hist is not None else ()) if x)) + ["\x00"] + tokens_of(", ".join(terms)))
            for field, text in (("target_ins", ins), ("reasoning", why)):
                if text is None or is_empty(text):
                    continue
                if _declines(machine, text):
                    out.append((row_id, field, "refusal"))
                if foreign_share(text) > 0.5:
                    out.append((row_id, field, "language"))
                copy = prompt.share(tokens_of(_LABEL.sub("", text)), 2, 0.75)
                if not copy and field == "target_ins" and why:
                    copy = Source(tokens_of(why)).share(tokens_of(text), 4, 0.8)
                if copy:
                    out.append((row_id, field, "copy"))
        yield pd.DataFrame(out, columns=["row_id", "field", "defect"])


LANGS = tuple(STOPWORDS)
#: What a known word may add to a language; the rate of an unseen n-gram; the mean log odds from which a list is foreign.
_KNOWN, _UNSEEN, _ODDS = 8.0, 1e-4, math.log(100)


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of the sentences whose language the stop words tell clearly, counted within the batch."""
    for pdf in batches:
        n: Counter = Counter()
        for s in pdf["s"]:
            votes = votes_of(s)
            if votes:
                lang = max(votes, key=votes.get)
                rest = max((v for k, v in votes.items() if k != lang), default=0)
                if votes[lang] >= 1.5 and votes[lang] >= 2 * rest:
                    n.update((lang, w) for w in set(_WORDS.findall(s)))
        yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["lang", "word", "n"])


def foreign_lists(lists: DataFrame, sentences: DataFrame) -> DataFrame:
    """The ``terms`` of the distinct ``lists`` (array<string>, lower case) that most of their terms and their sum of votes
    say are not English.

    ``sentences``: distinct ``s`` in lower case. Those whose language the stop words tell give words; a word votes by the
    share of its sentences in each language, one that none of them holds by the rates of its character n-grams of 2 to 4
    among the distinct words of a language. A list needs odds of a hundred to one a term, so unknown words are not
    foreign by themselves. All counts are joined, none is collected but the totals of a language.
    """
    words = sentences.mapInPandas(_told, "lang string, word string, n long").groupBy("word").agg(
        *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(x) for x in LANGS]
    )
    words = C.kept(words, "words")

    def grams(w):
        e = F.concat(F.lit("<"), w, F.lit(">"))
        some = [F.when(F.length(e) >= n, F.transform(F.sequence(F.lit(1), F.length(e) - (n - 1)), lambda i, n=n: F.substring(e, i, F.lit(n)))) for n in (2, 3, 4)]
        return F.flatten(F.array_compact(F.array(*some)))

    counts = words.select(F.explode(grams(F.col("word"))).alias("gram"), *LANGS).groupBy("gram").agg(*[F.count_if(F.col(x) > 0).alias(x) for x in LANGS])
    counts = C.kept(counts, "grams")
    total = counts.agg(*[F.sum(x).alias(x) for x in LANGS]).first()
    langs = [x for x in LANGS if total[x]]
    lists = C.kept(lists, "lists")
    if langs in ([], ["en"]):
        return lists.limit(0)
    each = lists.select("terms", F.posexplode("terms").alias("at", "term")).select(
        "terms", "at", F.explode(F.filter(F.split("term", r"[^\p{L}]+"), lambda w: F.length(w) > 1)).alias("word")
    )
    asked = C.kept(each.select("word").distinct(), "asked")
    seen = asked.join(words, "word")
    most = F.greatest(*[F.col(x) for x in langs]) if len(langs) > 1 else F.col(langs[0])
    seen = seen.select("word", *[(_KNOWN * F.col(x) / most).alias(x) for x in langs])
    guessed = asked.join(words, "word", "left_anti").select("word", F.explode(grams(F.col("word"))).alias("gram")).join(counts, "gram", "left")
    guessed = guessed.groupBy("word").agg(*[F.sum(F.log(F.coalesce(x, F.lit(0)) / total[x] + _UNSEEN)).alias(x) for x in langs])
    by_term = each.join(seen.unionByName(guessed), "word").groupBy("terms", "at").agg(*[F.sum(x).alias(x) for x in langs])
    foreign = [F.col(x) for x in langs if x != "en"]
    lead = (F.greatest(*foreign) if len(foreign) > 1 else foreign[0]) - (F.col("en") if "en" in langs else F.lit(0.0))
    by_list = by_term.groupBy("terms").agg(F.avg(lead).alias("lead"), (2 * F.count_if(lead > 0) > F.count("*")).alias("most"))
    return by_list.filter(F.col("most") & (F.col("lead") >= _ODDS)).select("terms")


def defects(rows: DataFrame) -> DataFrame:
    """``row_id, field, defect`` of each defective value, one row per defect.

    ``rows``: ``row_id, hist_sid, target_tid, target_ins, reasoning``. Null or empty lists and blank texts are 'empty'
    (never reasoning, which may be null); texts are read whole; repeated rows give repeated results; an empty table
    gives none. A list that declines is foreign when its stop words are, any other by the votes of ``foreign_lists``.
    Rows are independent, so skew does not matter; sentences, lists and terms are made distinct before they are joined.
    """
    rows = rows.select("row_id", "hist_sid", "target_tid", "target_ins", "reasoning")
    found = C.kept(rows.mapInPandas(_find, _DEFECT_SCHEMA), "found")
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("target_ins", "reasoning")])
    values = rows.select("row_id", clean_terms(F.col("target_tid")).alias("terms"), F.explode(texts).alias("x"))
    values = values.select("row_id", "x.field", "x.text", "terms").filter(F.col("text").isNotNull())
    cut, sentences = truncated_values(values, with_sentences=True)
    lists = rows.select(clean_terms(F.col("target_tid")).alias("terms")).filter((F.size("terms") > 0) & ~F.exists("terms", lambda x: x.contains("<s_a_"))).distinct()
    strange = foreign_lists(lists, sentences)
    odd = rows.select("row_id", clean_terms(F.col("target_tid")).alias("terms")).join(strange, "terms", "left_semi").select("row_id")
    silent = found.filter("field = 'target_tid'").select("row_id")
    odd = odd.join(silent, "row_id", "left_anti").select("row_id", F.lit("target_tid").alias("field"), F.lit("language").alias("defect"))
    return found.unionByName(odd).unionByName(cut.select("row_id", "field", F.lit("truncated").alias("defect")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(C.table(spark, sf_dir, "train_cid2ins"))


def p5_defect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective values per source, field and kind."""
    src = C.table(spark, sf_dir, "train_cid2ins").select("row_id", "source_dataset")
    return p5_found(spark, sf_dir).join(src, "row_id").groupBy("source_dataset", "field", "defect").agg(F.count("*").alias("n"))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_defect_report": p5_defect_report}
