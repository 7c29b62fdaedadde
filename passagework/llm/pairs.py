"""Broken prompt and response pairs, flagged with their type of defect.

* ``copy``: the reply is compressed with its prompt as a zstandard dictionary. If next to nothing is
  left to store, it says the prompt again; an exact look at what is left follows.
* ``truncated``: a terminal-context model. Contexts (kind of line, last sign) are counted over all
  replies where lines and sentences end, and where they don't; a reply that stops in a context where
  texts hardly ever end was broken off.
* ``refusal`` and ``other_language``: dictionaries of refusing phrases and of function words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.keys import is_blank
from passagework.llm.conversations import current_rows, replies
from passagework.session import cut_lineage

#: Function words and other everyday words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the a an of and or is are was were be been to in on at for with without by from this that these those it its as not no any which what when where why who how whoever someone before after between about if then than only can could should must may will would do does did i you we they he she my your our their me us there here have has had yes both each every once keep see first one two please tell list sure hello goodbye thanks thank thirty days twice year week month",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war waren sein zu zum zur im in am an auf für mit ohne bei von vom dieser diese dieses es als nicht kein keine welche was wann wo warum wer wie wenn dann nur kann können soll muss darf wird werden wurde ich sie wir ihr mein meine mich mir uns hier hat haben ja nein auch erst danach ebenso bis nach vor alle aus man oft bitte gerne gern hallo danke tage jahr monat woche zweimal einmal",
    "fr": "le la les l un une des du de d et ou est sont était être à au aux dans en sur pour avec sans par ce cette ces il elle on ne pas n aucun quel quelle quand où pourquoi qui que qu comment si alors seul peut doit je j vous nous ils mon ma mes me moi ici y a ont oui non aussi avant après entre ainsi lorsque une fois deux chaque semaine mois an cas selon faut-il faire sûr bien bonjour merci jours c s",
    "es": "el la los las un una unos unas y o es son era ser a al en de del con sin por para este esta estos estas lo no ningún qué cuál cuándo dónde por quién que cómo si entonces solo puede debe hay yo usted nosotros ellos mi mis me aquí tiene han sí también antes después entre según cuando una vez dos cada semana mes año casos hace falta claro hola gracias días se su sus le queda está están partir",
}
#: Scripts that need no words.
SCRIPTS = (("zh", r"[一-鿿]"), ("ja", r"[぀-ヿ]"), ("ko", r"[가-힯]"), ("ru", r"[Ѐ-ӿ]"), ("ar", r"[؀-ۿ]"), ("el", r"[Ͱ-Ͽ]"))
#: Names of languages, by which a question asks for one.
ASKED = re.compile(
    r"\b(?:in|into|to|auf|ins|en|au|al|in das) (?:the )?(?:english|german|french|spanish|chinese|japanese|korean|italian|portuguese|deutsch|deutsche|englisch|englische|französisch|französische|spanisch|spanische|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b|\b(?:translat|übersetz|tradui|traduc|tradúz)\w*",
    re.I,
)
#: Phrases that refuse, or say that there is nothing to answer with.
REFUSALS = re.compile(
    r"""\bI(?:\ am|'m|\ was)?\ (?:really\ )?(?:not\ able\ to|unable\ to|not\ allowed\ to|not\ permitted\ to|not\ in\ a\ position\ to)
    |\bI\ (?:can(?:no|')t|can\ not|won't|will\ not|must\ not|may\ not|could\ not|couldn't)\ (?:help|answer|assist|discuss|comment|provide|share|tell|say|respond|go\ into|do\ that|do\ this|give)
    |\bI\ (?:must|have\ to|need\ to|would\ have\ to)\ (?:decline|refuse|pass\b)|\bI\ (?:decline|refuse)\b|\bsomething\ I\ (?:must|have\ to)\ decline
    |\bI\ would\ rather\ not|\bI'd\ rather\ not|\bI\ prefer\ not\ to
    |\bI\ (?:have|know|found|find|see|could\ find|can\ find)\ (?:nothing|no\ (?:information|passage|answer|evidence|source|document))|\bI\ do(?:\ not|n't)\ (?:know|have\ (?:any|enough|the)\b)
    |\b(?:nothing|no\ passage|no\ document|no\ source)\ in\ (?:this|the|our|my)\ [\w\ ]{3,30}\ (?:lets|allows|helps|answers|supports)
    |\bnot\ enough\ (?:evidence|information|context|material)\b|\binsufficient\ (?:evidence|information)\b
    |\b(?:outside|beyond|exceeds|goes\ beyond)\ what\ I\ (?:may|can|am)|\bwrong\ of\ me\ to|\bnot\ something\ I\ am\ (?:permitted|allowed|able)|\bkeep\ me\ from|\bprevents?\ me\ from|\bagainst\ my\ (?:instructions|rules|guidelines)|\bas\ an\ (?:AI|assistant)
    |\b(?:kann|darf|möchte|will|werde)\ ich\ (?:\w+\ ){0,5}(?:nicht|nichts|kein\w*)\b|\bich\ (?:kann|darf|möchte|will|werde)\ (?:\w+\ ){0,5}(?:nicht|nichts|kein\w*)\b|\b(?:muss\ ich|ich\ muss)\ [\w\ ]{0,40}\b(?:ablehnen|passen|absagen)
    |\b(?:liegt|liegen)\ mir\ [\w\ ]{0,40}\b(?:nichts|keine?)\b|\b(?:habe|finde|fand|weiß|sehe)\ ich\ (?:\w+\ ){0,5}(?:nichts|kein\w*)\b|\bich\ (?:habe|finde|fand|weiß|sehe)\ (?:\w+\ ){0,5}(?:nichts|kein\w*)\b|\bmir\ (?:ist\ )?(?:nicht\ (?:erlaubt|gestattet|möglich)|fehlen)|\bnicht\ (?:befugt|berechtigt)|\breicht\ (?:die|das)\ [\w\ ]{3,40}\ nicht
    |\bje\ (?:ne\ (?:peux|puis|dois|sais|veux|trouve|dispose|suis|saurais)|n'ai|refuse|préfère\ ne\ pas|dois\ (?:refuser|décliner)|regrette)|\bne\ me\ permet\w*|\bce\ que\ je\ suis\ autorisé|\bm'(?:empêche\w*|est\ (?:interdit|impossible))|\bje\ n'y\ trouve|\bje\ ne\ (?:suis|me)
    |\bno\ (?:puedo|debo|sé|tengo|encuentro|encontré|quiero|dispongo|estoy\ autorizad\w|me\ (?:es\ posible|está\ permitido|permite\w*))\b|\bme\ permite\ (?:responder|contestar|ayudar)|\bfuera\ de\ lo\ que\ puedo|\bprefiero\ no|\bdebo\ (?:rechazar|declinar)|\btengo\ que\ (?:rechazar|declinar|pasar)|\bme\ impiden?\b""",
    re.I | re.X,
)
#: What stands around a refusal without answering anything.
AROUND = re.compile(
    r"^(?:(?:i'?m |i am )?(?:so |very )?sorry|apologies|my apologies|unfortunately|regrettably|please contact|please ask|is there anything else|let me know|tut mir leid|es tut mir leid|leider|bitte (?:fragen|wenden)|entschuldigung|désolée?|je suis désolée?|malheureusement|merci de|veuillez|lo siento|lo lamento|por desgracia|desafortunadamente|lamentablemente|consulte|póngase|perdón)\b",
    re.I,
)

_MARK, _FIELD = re.compile(r"\s*(?:[-*•]|(\d+[.)]))"), re.compile(r"[^.!?:]{1,60}: ?[^.!?:]{0,24}")
_OPENING, _INNER_WORD_END = {"“": "”", "(": ")", "[": "]"}, re.compile(r"\S(?=\s)")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”»)\]]*(?=\s|$)|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SCRIPTS = [(k, re.compile(p)) for k, p in SCRIPTS]
_LEXICON: dict[str, list[str]] = {}
for _language, _listed in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_listed.split()):
        _LEXICON.setdefault(_w, []).append(_language)
_SPECIAL = re.compile(r"[ñ¿¡]|[äöüß]|[êèçœùàâî]", re.I)


def language_scores(text: str) -> Counter:
    """Weight of each language in a text: function words that not all languages share, letters, scripts."""
    scores: Counter = Counter()
    low = text.lower()
    for word, n in Counter(_WORD.findall(low)).items():
        for part in (word, *(word.split("'", 1) if "'" in word else ())):
            hits = _LEXICON.get(part, ())
            for k in hits:
                scores[k] += n / len(hits) ** 2
    if not text.isascii():
        for name, script in _SCRIPTS:
            n = len(script.findall(text))
            if n:
                scores[name] += n / 2
        for c in _SPECIAL.findall("".join(_WORD.findall(low))):
            scores["es" if c in "ñ" else "de" if c in "äöüß" else "fr"] += 0.3
        scores["es"] += 2 * len(re.findall("[¿¡]", text))
    return scores


def main_language(text: str) -> tuple[str | None, float]:
    """(language, lead over the next one); None if nothing tells."""
    top = language_scores(text).most_common(2)
    if not top or top[0][1] <= 0:
        return None, 0.0
    return top[0][0], top[0][1] - (top[1][1] if len(top) > 1 else 0)


def is_other_language(prompt: str, reply: str) -> bool:
    """Mainly in another language than the prompt, which didn't ask for that."""
    if ASKED.search(prompt):
        return False
    wanted, sure = main_language(prompt)
    got, lead = main_language(reply)
    if wanted is None or got is None or wanted == got or sure < 0.8:
        return False
    return lead >= 1.5 or (lead >= 0.9 and language_scores(reply)[wanted] == 0)


def is_refusal(reply: str) -> bool:
    """Every sentence refuses or stands around a refusal, and at least one refuses."""
    refused = False
    for sentence in re.split(r"(?<=[.!?;])\s+|\n+", reply.strip()):
        if REFUSALS.search(sentence):
            refused = True
        elif _WORD.search(sentence) and not AROUND.search(sentence):
            return False
    return refused


def plain(text: str) -> str:
    """Words of a text in lower case, one space apart."""
    return " ".join(re.findall(r"\w+", text.lower()))


def is_copy(prompt: str, reply: str) -> bool:
    """Says the prompt again and nothing more: with the prompt as dictionary hardly any byte must be stored,
    and what stands besides the prompt is at most three words before it."""
    import zstandard

    p, r = plain(prompt), plain(reply)
    if not p or not r or len(r) < len(p):
        return False
    raw = r.encode()
    packed = len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(p.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw)) if len(raw) >= 8 else len(raw)
    if len(raw) >= 8 and packed > 48 + len(raw) // 20:
        return False
    lead, *rest = r.split(p)
    return bool(rest) and len(lead.split()) <= 3 and not any(x.strip() for x in rest)


def contexts(line: str, cuts: list[int], fences: int) -> Iterator[tuple[str, str]]:
    """(kind of the line, last sign) of a text that stops in its last line at each of the ``cuts`` (rising, each behind a
    sign that isn't white space); ``open`` if something is still to be closed. ``fences``: code fences before the line.
    The line is read once, whatever the number of cuts."""
    begin = _MARK.match(line)
    bar = line.find("|") % (len(line) + 1)
    ticks = [m.end() for m in re.finditer("```", line)] if "```" in line else []
    pairs = [(a, b) for a, b in _OPENING.items() if a in line]
    ahead, passed, at = [0] * len(pairs), 0, 0
    for cut in cuts:
        for i, (a, b) in enumerate(pairs):
            ahead[i] += line.count(a, at, cut) - line.count(b, at, cut)
        while passed < len(ticks) and ticks[passed] <= cut:
            passed += 1
        at = cut
        if (fences + passed) % 2 or any(n > 0 for n in ahead):
            yield "open", ""
            continue
        if line.endswith("```", 0, cut):
            kind = "fence"
        elif begin and begin.end() == cut:
            kind = "mark"
        elif begin and begin.end() < cut and line[begin.end()].isspace():
            kind = "number" if begin[1] else "item"
        elif cut <= 90 and _FIELD.fullmatch(line, 0, cut):
            kind = "field"
        else:
            kind = "table" if bar < cut else "prose"
        last = line[cut - 1 : cut]
        yield kind, "a" if last.isalpha() else "9" if last.isdigit() else last


def context(text: str) -> tuple[str, str]:
    """The context in which a whole text stops."""
    *before, line = text.rstrip().split("\n")
    return next(contexts(line, [len(line)], sum(x.count("```") for x in before)))


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts at the ends of inner lines and sentences, and at word ends where no text ends."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["reply"]:
            lines = text.rstrip().split("\n")
            fences = 0
            for i, line in enumerate(lines):
                whole, final = line.rstrip(), i + 1 == len(lines)
                if whole:
                    ends = {m.end() for m in _SENTENCE_END.finditer(whole)}
                    words = {m.end() for m in _INNER_WORD_END.finditer(whole)}
                    skipped = max(ends, default=0) if final else -1  # the last one of a text may be a cut
                    cuts = sorted((ends | words | ({len(whole)} if not final else set())) - {skipped})
                    for cut, where in zip(cuts, contexts(whole, cuts, fences), strict=True):
                        ended = cut == len(whole) or (cut in ends and where[0] != "mark")  # the sign of a list item ends nothing
                        seen[(*where, ended)] += 1
                fences += line.count("```")
    yield pd.DataFrame([(k, s, e, n) for (k, s, e), n in seen.items()], columns=["kind", "sign", "ends", "n"])


def terminal_contexts(replies: DataFrame) -> dict[tuple[str, str], float]:
    """Share of the places with a context at which a text ends, over all ``replies`` (column reply).
    There are about ten kinds and as many signs as final signs occur, so the table is small whatever the corpus."""
    counts = replies.mapInPandas(_observe, "kind string, sign string, ends boolean, n long").groupBy("kind", "sign").agg(F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("ends"), F.sum("n").alias("n"))
    return {(r["kind"], r["sign"]): r["ends"] / r["n"] for r in counts.collect()}


def is_truncated(reply: str, model: dict[tuple[str, str], float], least: float = 0.2) -> bool:
    """Stops where texts hardly ever end. Contexts that were never seen: a final sign of punctuation ends a text."""
    where = context(reply)
    if where[0] == "open":
        return True
    if where in model:
        return model[where] < least
    return where[1] not in ".!?…。！？”»)]`" or where[0] == "mark"


def defects(chat: DataFrame) -> DataFrame:
    """id, defect of every defective pair: ``empty``, ``copy``, ``refusal``, ``truncated`` or ``other_language``, the first
    that holds. Pairs are those of ``replies``. Very long texts are looked at as a whole; a pair that occurs in
    several states or copies of a row counts once. No rows give no defects."""
    rows = cut_lineage(current_rows(chat).select("id", "conversation", "at", "has_user", "has_bot", "user_query", "bot_response"))
    texts, pairs = rows.where("id is not null"), replies(rows).where("id is not null")
    asked = pairs.join(texts.select("id", F.col("user_query").alias("prompt")), "id")
    both = cut_lineage(asked.join(texts.select(F.col("id").alias("reply_id"), F.col("bot_response").alias("reply")), "reply_id", "left").select("id", "prompt", "reply"))
    answered = both.where(~is_blank(F.col("reply")))
    model = chat.sparkSession.sparkContext.broadcast(terminal_contexts(answered.select("reply")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, prompt, reply in zip(batch["id"], batch["prompt"], batch["reply"], strict=True):
                if is_copy(prompt, reply):
                    out.append((rid, "copy"))
                elif is_refusal(reply):
                    out.append((rid, "refusal"))
                elif is_truncated(reply, model.value):
                    out.append((rid, "truncated"))
                elif is_other_language(prompt, reply):
                    out.append((rid, "other_language"))
            yield pd.DataFrame(out, columns=["id", "defect"])

    empty = both.where(is_blank(F.col("reply"))).select("id", F.lit("empty").alias("defect"))
    return empty.unionByName(answered.mapInPandas(judge, "id string, defect string"))
