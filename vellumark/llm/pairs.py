"""Broken prompt and response pairs: each faulty pair with its defect.

Method: a suffix automaton of the prompt's words measures how much of the response is copied from it; Aho–Corasick
automata over classes of words find refusals outside quotations; a stack of delimiters finds what is left open; stop-word votes compare the
languages of prompt and response. A response that ends in a plain word may be cut off or only lack its full stop: that is told by
the word itself (an article or preposition ends nothing), and by how often, over all responses, sentences end in the same words
and how often they go on after them; the more often words were seen, the more they count against the word itself.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.consistent import with_consistent
from vellumark.llm.function_words import STOPWORDS
from vellumark.llm.refusals import may_refuse, refuses
from vellumark.tables import Cut

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: A response with at most so many words outside copied runs, each of RUN words or more, only repeats its prompt.
TRIMMINGS, RUN = 2, 4
#: Least part of a context's occurrences that must end a sentence for a response to be complete there.
ENDS = 0.2
#: What the shorter context, and in the end the last word itself, weighs against a context's occurrences.
SUPPORT = 5.0
#: How likely a sentence ends, where nothing else is known: after a word that may end one, and after one that can't.
MAY_END, CANT_END = 0.5, 0.02

# Words that no sentence ends in (articles, conjunctions, prepositions and the like), one list per language.
UNFINISHED = {
    "en": "the a an of and that to with for by from which as but or if where while than because between into their his her its my our your what who whose when so nor yet",
    "de": "der die das den dem des und ein eine einen einem einer von mit für im in zu dass bei über aus oder aber wenn weil sowie zwischen gegen ihre seine deren dessen ob als wie daher deshalb",
    "fr": "le la les de des du et que qui un une dans pour sur par au aux ce cette ces son sa ses leur avec ou mais si comme dont donc sans entre en à d l qu",
    "es": "el la los las de del y e que un una unos unas en por con al para como o u pero si su sus sin sobre entre según cuyo cuya desde hasta",
    "pt": "o a os as de do da dos das e que um uma em no na nos nas por com ao à para como ou mas se seu sua sem sobre entre pelo pela",
    "ru": "и в во на с со что по как из за для от до о об к но или если при без между чтобы который которая которое которую у под над",
}
_UNFINISHED = frozenset(w for words in UNFINISHED.values() for w in words.split())
# The labels that a verdict may have, by language.
LABELS = {
    "en": ["supported", "refuted", "not enough evidence"],
    "de": ["gestützt", "widerlegt", "nicht genug belege"],
    "fr": ["confirmé", "réfuté", "preuves insuffisantes"],
    "es": ["respaldada", "refutada", "pruebas insuficientes"],
    "pt": ["confirmada", "refutada", "provas insuficientes"],
    "ru": ["подтверждено", "опровергнуто", "недостаточно данных"],
}
OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "‘": "’", "‹": "›"}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _VOTES.setdefault(_w, []).append(_lang)
_MARK = re.compile("[\"'’()\\[\\]{}«»“”„‘‹›]")
_SENTENCE_END = re.compile(r"(?<![.])[»”\"')\]]*[.!?](?![.])[»”\"')\]]*(?=\s|$)")
_OR = re.compile(r",|;|/|\s(?:or|oder|ou|o|или|und|and|et|y|e|и)\s")


class SuffixAutomaton:
    """All runs of consecutive words of a text, in as many states as twice its words at most."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def covered(self, words: list[str], run: int) -> int:
        """How many of the words lie in a run of at least `run` words that the text holds too."""
        state = have = total = end = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                have += 1
            else:
                have = 0
            if have >= run:
                total += i + 1 - max(end, i + 1 - have)
                end = i + 1
        return total


def quotations(text: str) -> tuple[str, bool]:
    """The text outside quotation marks, and whether a quotation or bracket is left open at its end.

    A straight single quote opens before a letter and after a blank or bracket, and closes after a character that isn't a
    blank; elsewhere it is an apostrophe.
    """
    stack: list[str] = []
    out: list[str] = []
    at, quotes = 0, 0
    for m in _MARK.finditer(text):
        i, c = m.start(), m.group()
        if not quotes:
            out.append(text[at:i])
        at = i + 1
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if stack and c == stack[-1] and not (c in "'’" and (after.isalnum() or c == "'" and not before.strip())):
            bracket = stack.pop() in ")]}"
            quotes -= not bracket
            if bracket and not quotes:
                out.append(c)
        else:
            close = OPEN.get(c, "")
            if c == "\"":
                close = c
            elif c == "'":
                close = c if after.isalnum() and not before.isalnum() and before != c else ""
            elif c == "„":
                close = "“" if "“" in text[i:] else "”"
            elif c == "‘" and before.isalnum():
                close = ""
            if close:
                stack.append(close)
                quotes += close not in ")]}"
            if not quotes and (not close or close in ")]}"):
                out.append(c)
    if not quotes:
        out.append(text[at:])
    return "".join(out), bool(stack)


def language(words: list[str]) -> str | None:
    """The language with most function words among the words, if it leads clearly; Cyrillic letters alone make Russian."""
    counts = Counter(words)
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in counts.keys() & _VOTES.keys():
        for lang in _VOTES[w]:
            votes[lang] += counts[w]
    if max(counts, default="") >= "а":
        cyrillic = sum(n for w, n in counts.items() if "а" <= w[0] <= "ё")
        if cyrillic * 3 > len(words):
            votes["ru"] += cyrillic
    second, first = sorted(votes.values())[-2:]
    return max(votes, key=votes.__getitem__) if first >= 2 and first > second else None


def labels_in(prompt: str) -> list[str]:
    """The labels that the last line of a prompt offers after its colon, in lower case; none if it offers none."""
    line = prompt.rstrip().rpartition("\n")[2].lower()
    if ":" not in line:
        return []
    found = [x.strip(" .!?\"'") for x in _OR.split(line.rpartition(":")[2])]
    found = [x for x in found if x]
    return found if len(found) >= 2 and all(len(x.split()) <= 4 for x in found) else []


def mask(words: list[str]) -> list[str]:
    """Names (several in a row as one) and numbers by their kind, other words in lower case."""
    out: list[str] = []
    for i, w in enumerate(words):
        if w[0].isupper() and i:
            if out[-1] != "N":
                out.append("N")
        else:
            out.append(f"#{len(w)}" if w.isdigit() else w.lower())
    return out


def sentence_contexts(text: str, every: Counter, ends: Counter) -> None:
    """Counts each run of three masked words of a text, all and those that a sentence ends after; "^ ^" begins a sentence.

    How an unclosed last sentence breaks off is no observation.
    """
    at = 0
    for m in _SENTENCE_END.finditer(text):
        masked = ["^", "^", *mask(WORD.findall(text, at, m.start()))]
        at = m.end()
        if len(masked) > 2:
            every.update(zip(masked, masked[1:], masked[2:], strict=False))
            ends[tuple(masked[-3:])] += 1
    masked = ["^", "^", *mask(WORD.findall(text, at))]
    every.update(list(zip(masked, masked[1:], masked[2:], strict=False))[:-1])


class Prompt:
    """What judging needs of a prompt."""

    def __init__(self, prompt: str, labelled: bool, lang: str | None):
        self.words = WORD.findall(prompt.lower())
        self.known = set(self.words)
        self.labels = labels_in(prompt) if labelled else []
        self.language = language(self.words) or (lang or "").strip().lower()[:2] or None


def judge(prompt: Prompt, answer: str | None) -> tuple[str | None, str | None]:
    """(defect, context) of a pair in consistent form.

    Without a defect, the last three masked words are given of a response that ends in a plain word: whether it is cut off depends on them.
    """
    if answer is None or not any(map(str.isalnum, answer)):
        return "empty", None
    text = answer.strip()
    lower = text.lower()
    words = WORD.findall(lower)
    if prompt.labels:
        bare = re.sub(r"\s+", " ", text.strip(" \t\r\n.!?,;:…\"'«»“”*")).lower()
        if bare in prompt.labels:
            return None, None
        if any(x.startswith(bare) for x in prompt.labels):
            return "truncated", None
        if any(bare in known for known in LABELS.values()):
            return "other_language", None
    if len(words) >= 3 and sum(map(prompt.known.__contains__, words)) >= len(words) - TRIMMINGS:
        auto = SuffixAutomaton(prompt.words)
        if len(words) - auto.covered(words, min(RUN, len(words))) <= min(TRIMMINGS, len(words) // 4):
            return "copied", None
    unquoted = quotations(text)[0]
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    last = text[max((e for e in ends if e < len(text)), default=0) :]
    if may_refuse(lower, words) and refuses(unquoted):
        return "refusal", None
    said = language(WORD.findall(unquoted.lower()) if len(unquoted) < len(text) else words)
    if said and prompt.language in STOPWORDS and said != prompt.language:
        return "other_language", None
    if quotations(last)[1]:
        return "truncated", None
    ending = re.sub(r"[»”\"')\]\s]+$", "", text)
    if ending.endswith(("...", "…")) or ending[-1:] in ",;:-–—([{«“„/":
        return "truncated", None
    if ending[-1:] in ".!?":
        return None, None
    return None, " ".join(["^", "^", *mask(WORD.findall(last))][-3:])


def defects(pairs: DataFrame, tables: dict[str, bool]) -> DataFrame:
    """(source_table, record_key, defect) of each faulty pair.

    pairs: (source_table, record_key, prompt, answer, lang); lang is used only where the prompt shows no language. tables: for each
    source_table whether its prompts may ask for a label. Repeated pairs count once. A null or blank answer is empty; with a null prompt
    only what the answer itself shows counts. A pair gets one defect: empty, then copied, refusal, other_language, truncated.
    """
    form = with_consistent(pairs.select("source_table", "record_key", "prompt", "answer", "lang").distinct(), ["prompt", "answer"])
    form = form.select("source_table", "record_key", "prompt_consistent", "answer_consistent", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_table", "record_key", "defect", "context", "n_end", "n_mid"]
        types = [pa.string()] * 4 + [pa.int64()] * 2
        ends: Counter = Counter()
        every: Counter = Counter()

        def table(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        def contexts() -> pa.RecordBatch:
            keys = list(every)
            made = table([[None] * len(keys)] * 3 + [[" ".join(k) for k in keys], [ends[k] for k in keys], [every[k] - ends[k] for k in keys]])
            ends.clear()
            every.clear()
            return made

        for b in batches:
            rows, prompts, answers, langs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), *(c.to_pylist() for c in b.columns[2:])
            judged = [judge(Prompt(p or "", tables.get(t, False), g), a) for (t, _), p, a, g in zip(rows, prompts, answers, langs, strict=True)]
            for (d, _), a in zip(judged, answers, strict=True):
                if d in (None, "truncated") and a:
                    sentence_contexts(a, every, ends)
            kept = [(*r, *j) for r, j in zip(rows, judged, strict=True) if j[0] or j[1]]
            yield table([*(list(c) for c in zip(*kept, strict=True)), [None] * len(kept), [None] * len(kept)] if kept else [[]] * 6)
            if len(every) > 200_000:
                yield contexts()
        yield contexts()

    seen = Cut(form.mapInArrow(run, "source_table string, record_key string, defect string, context string, n_end long, n_mid long")).df
    counts = seen.where("n_end is not null").groupBy("context").agg(F.sum("n_end").alias("e3"), F.sum("n_mid").alias("m3"))
    records = seen.where("n_end is null").select("source_table", "record_key", "defect", "context")
    part = lambda k, n: F.array_join(F.slice(F.split("context", " "), k, n), " ")
    fewer = lambda c, k: counts.groupBy(c).agg(F.sum("e3").alias(f"e{k}"), F.sum("m3").alias(f"m{k}"))
    counts = Cut(counts.withColumn("two", part(2, 2)).withColumn("one", part(1, 2))).df
    asked = records.where("defect is null").withColumn("two", part(2, 2)).withColumn("one", part(1, 2))
    asked = asked.join(counts.drop("one", "two"), "context", "left").join(fewer("two", 2), "two", "left").join(fewer("one", 1), "one", "left")
    p = F.when(part(3, 1).isin(sorted(_UNFINISHED)), F.lit(CANT_END)).otherwise(F.lit(MAY_END))
    for k in (1, 2, 3):  # any word after the two before it, the last two words, the last three
        e, m = F.coalesce(f"e{k}", F.lit(0)), F.coalesce(f"m{k}", F.lit(0))
        p = (e + SUPPORT * p) / (e + m + SUPPORT)
    cut_off = asked.where(p < ENDS).select("source_table", "record_key", F.lit("truncated").alias("defect"))
    return records.where("defect is not null").select("source_table", "record_key", "defect").unionByName(cut_off).distinct()


def project_pairs(answers: DataFrame, responses: DataFrame, predictions: DataFrame) -> DataFrame:
    """The pairs of this project's tables; a prediction is a pair only if its stages hold 'explanation'."""
    parsed = answers.select("key", F.from_json("response", "answer string, prompt string").alias("r"))
    none = F.lit(None).cast("string")
    a = parsed.select(F.lit("answers").alias("source_table"), F.col("key").alias("record_key"), F.col("r.prompt").alias("prompt"), F.col("r.answer").alias("answer"), none.alias("lang"))
    r = responses.select(F.lit("responses_used").alias("source_table"), F.col("key").alias("record_key"), "prompt", "answer", none.alias("lang"))
    p = predictions.where(F.array_contains("stages", "explanation")).select(
        F.lit("predictions").alias("source_table"), F.col("prediction_id").cast("string").alias("record_key"), F.col("claim").alias("prompt"), F.col("generated_explanation").alias("answer"), F.col("language").alias("lang")
    )
    return a.unionByName(r).unionByName(p)
