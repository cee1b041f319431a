"""Refusals told by the pattern of their words, not by fixed phrases.

Each language has classes of words (first person, modal, negation, verb of answering, ...). A clause becomes the string of its words'
classes, words that only fill are left out, and an Aho–Corasick automaton of class patterns (first person, modal, negation, verb, in the orders
that the language has) runs over it. Only the first sentences of an answer can decline the task, however long they are; a greeting or a word of
thanks is no sentence, and the point of a date, number or initial ends none.
"""

from __future__ import annotations

import functools
import itertools
import re

#: Sentences from the beginning in which a task is declined; the words that one has at least.
HEAD, LEAST_WORDS = 2, 3

# Words by class. F first person, M modal or auxiliary, N negation, V verb of answering, W such a verb that needs an addressee or
# object (O), A able or allowed, R verb of declining, P preference, E permitted (impersonal), D addressee of the permission (me), Q fitting,
# Y possessive, G rules, B to keep from, T beyond, L language model, H to have, C opinion, U first-person future with negation, f filler.
LEXICON = {
    "en": {
        "F": "i we", "M": "can could will would may must should shall am are do have", "N": "not never unable", "R": "decline refuse abstain refrain declining refusing", "P": "prefer rather",
        "V": "answer answering help helping assist assisting provide providing discuss discussing comply complying comment commenting judge judging evaluate evaluating assess explain explaining share sharing offer respond responding verify check checking fulfil fulfill engage speak complete process participate advise elaborate weigh",
        "W": "give giving tell telling do doing say saying show send write make talk take", "O": "you that this it here position part anything",
        "A": "able allowed permitted authorised authorized comfortable willing position going prepared qualified free", "Q": "appropriate right proper possible", "D": "me us", "Y": "my our", "G": "guidelines guideline policy policies rules instructions programming principles",
        "B": "prevent prevents keep keeps forbid forbids prohibit prohibits stop stops bar bars disallow", "T": "outside beyond against exceeds", "L": "@model ai", "H": "have hold", "C": "opinion opinions comment view views",
        "f": "really simply just unfortunately sadly afraid sorry be to a an the in of for with any at what is was large as feel feeling fully also honestly currently really no on into from @no",
    },
    "de": {
        "F": "ich wir", "M": "kann können darf dürfen möchte möchten will werde werden muss müssen mag könnte bin habe sehe", "N": "nicht nichts kein keine keinen keinem keiner keinerlei außerstande",
        "V": "helfen weiterhelfen beantworten beantworte antworten beurteilen bewerten prüfen kommentieren kommentiere äußern erklären erläutern besprechen diskutieren bearbeiten erfüllen nachkommen entsprechen mitteilen verraten einschätzen auskunft auskünfte angaben stellung stellungnahme kommentar sagen sage geben unterstützen dienen erteilen beitragen",
        "R": "ablehnen verweigern lehne verweigere passen verzichten absehen", "P": "lieber", "A": "imstande befugt berechtigt lage autorisiert ermächtigt bereit", "E": "erlaubt gestattet möglich erlauben gestatten untersagt verboten", "D": "mir uns", "Y": "meine meinen unsere", "G": "richtlinien regeln vorgaben",
        "B": "verbieten untersagen hindern", "L": "sprachmodell ki", "C": "meinung", "H": "habe",
    },
    "fr": {
        "F": "je j nous", "M": "peux puis pourrais pouvons dois veux souhaite vais suis saurais voudrais ai", "N": "ne n pas rien aucun aucune point",
        "V": "aider répondre commenter juger évaluer fournir donner dire expliquer parler discuter vérifier traiter satisfaire prononcer assister communiquer révéler réponse commentaire", "U": "répondrai commenterai aiderai dirai fournirai",
        "A": "mesure autorisé autorisée habilité habilitée capable prêt prête position", "E": "permis possible autorisé", "D": "m moi me", "R": "refuse refuser décline décliner abstiens abstenir", "P": "préfère préférerais", "Y": "mes nos", "G": "règles directives consignes", "B": "interdisent empêchent défendent", "L": "@modèle ia",
        "f": "vous te t le la l les de d en y à à sur cette ce cet ces votre est c être malheureusement désolé désolée regrette hélas vraiment là ici lui leur se s au aux avec que une un mais plus",
    },
    "es": {
        "F": "yo nosotros", "M": "puedo podemos podría debo quiero deseo voy estoy soy tengo quisiera", "N": "no ni nada ningún ninguna",
        "V": "ayudar ayudarte ayudarle ayudarlo ayudarla ayudarles responder responderte responderle contestar contestarte contestarle opinar comentar juzgar valorar evaluar proporcionar proporcionarte dar darte darle decir decirte decirle explicar hablar tratar cumplir atender discutir ofrecer facilitar compartir verificar comprobar pronunciarme asistir asistirte revelar",
        "U": "responderé contestaré ayudaré opinaré comentaré explicaré hablaré diré", "A": "condiciones autorizado autorizada capacitado capacitada dispuesto dispuesta capaz", "E": "permite permiten permitido posible", "D": "me nos mí", "R": "niego negarme rechazo rechazar rehúso rehusar declino declinar abstengo abstenerme", "P": "prefiero preferiría",
        "Y": "mis nuestras", "G": "normas directrices reglas instrucciones", "B": "impiden prohíben impide prohíbe", "L": "@modelo ia", "H": "tengo", "C": "opinión",
        "f": "se te le lo la los las les a de en con esta este esto eso esa ese sobre para que es siento lamento perdón lamentablemente pero el su tu una un ahora aquí realmente más",
    },
    "pt": {
        "F": "eu nós", "M": "posso podemos poderia devo quero desejo vou estou consigo sou gostaria tenho", "N": "não nem nada nenhum nenhuma",
        "V": "ajudar ajudá ajudar-te ajudá-lo responder responder-lhe comentar julgar avaliar fornecer dar dizer dizer-lhe explicar falar discutir opinar cumprir atender verificar oferecer partilhar compartilhar revelar auxiliar pronunciar-me pronunciar",
        "U": "responderei ajudarei comentarei opinarei direi", "A": "condições autorizado autorizada apto apta disposto disposta capaz permissão", "E": "permitido possível permite permitem", "D": "me nos mim", "R": "recuso recuso-me recusar declino declinar recusar-me", "P": "prefiro preferia preferiria", "Y": "minhas nossas meu", "G": "diretrizes regras normas instruções",
        "B": "impedem proíbem impede", "L": "@modelo ia", "H": "tenho", "C": "opinião",
        "f": "te lhe lo la o a os as de em com esta este isto isso essa esse sobre para que é ser em infelizmente lamento desculpe sinto muito mas ao à seu sua uma um nisso aqui realmente mais por",
    },
    "ru": {
        "F": "я мы", "M": "могу можем буду стану хочу смогу должен должна готов готова намерен намерена", "N": "не нет ничего нельзя", "E": "разрешено позволено дозволено запрещено запрещают позволяют", "D": "мне нам", "A": "вправе уполномочен уполномочена имею", "R": "отказаться отказываюсь воздержусь воздержаться отклоняю отказать", "P": "предпочитаю предпочту предпочёл предпочла",
        "V": "помочь помогать ответить отвечать комментировать прокомментировать оценивать оценить обсуждать говорить сказать рассказать объяснять объяснить предоставить дать давать судить высказываться проверить проверять выполнить выполнять отзываться права поделиться раскрывать", "Y": "мои наши", "G": "правила инструкции", "B": "запрещают мешают", "L": "@модель ии", "H": "имею", "C": "мнения",
        "f": "вам тебе это этого эту на о об с по в к сожалению извините простите простить но бы никак здесь такие такой ваш вашу ваше вопрос запрос просьбу вынужден вынуждена этот",
    },
}
# How the classes follow one another where a task is declined; "(AB)" is A or B.
PATTERNS = {
    "en": "FMNV FMNWO FMNA(VWE) FMNA FNV FMR FR FPNV FMPNV FMPN FPN TFMA TFM TYG NQD YGB YGMN L FHNC FMNHC FHC FMNMV FMNMO",
    "de": "FM*N*V MF*N*V FN*V F*NV MF*P*N FM*P*N FPN MF*R FM*R FR FM*N*A MF*N*A MDN*E DMN*E DN*E MDNE NDE DE YG*B YGB L FHNC HFNC MFN*E HF*NV",
    "fr": "FNMNV FNMN(A) FMNV FNU FUN FMR FR FPNV FPNNV FPN NDNE NDN*E NDE FNDNE NMNV FNMV YGB YGDB L FNMRNV FNMNA FNMDV NMDV FNDMV FNDMNV",
    "es": "NMV NMA FNMV NDE NE(V) MR FR R(V) DR PNV PN PNNV NU YGB YGDB L NHC NMFA",
    "pt": "NMV NMA FNMV NDE NED NE(V) MR FR R PNV PN NU YGB YGDB L NHC",
    "ru": "FNMV NMV NMFV FNA NAV NA FMR FR R DNE DE DN(V) NDE FPN PN PNV YGB YGDB L FNHC NHC FNMR DNV",
}
_TWO = {"language model": "@model", "modèle de langage": "@modèle", "modèle linguistique": "@modèle", "modelo de lenguaje": "@modelo", "modelo lingüístico": "@modelo", "modelo de linguagem": "@modelo", "языковая модель": "@модель"}
_WORD = re.compile(r"@?[^\W_]+(?:-[^\W_]+)*|[.!?;:]+|,")
# A stop that a sentence can end in: a blank, bracket or quotation mark comes after it, or nothing.
_STOP = re.compile(r"[.!?]+(?=[\s)\]}\"'’”»]|$)")
_WORD_BEFORE = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_SHORT = [(re.compile(a), b) for a, b in ((r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\bcannot\b", "can not"), (r"\bshan't\b", "shall not"), (r"n't\b", " not"), (r"\bi'm\b", "i am"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'ve\b", " have"), (r"'re\b", " are"))]


@functools.cache
def _classes(language: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, words in LEXICON[language].items():
        for w in words.split():
            if name != "f" or w not in out:
                out.setdefault(w, name)
    return out


# Which classes an answer must have a word of, by language, to be looked at further.
_NEEDED = {"en": "FDYL", "de": "FDYL", "fr": "FDYL", "es": "FMRPUEDYL", "pt": "FMRPUEDYL", "ru": "FMRPADYL"}


@functools.cache
def _languages() -> dict[str, frozenset[str]]:
    """Word to the languages in which it may belong to somebody who declines."""
    out: dict[str, set[str]] = {}
    for language, classes in _NEEDED.items():
        for w, c in _classes(language).items():
            if c in classes:
                out.setdefault(w, set()).add(language)
    return {w: frozenset(x) for w, x in out.items()}


@functools.cache
def signs() -> frozenset[str]:
    """Words, as they stand in texts, without one of which nothing is declined."""
    found = {w.lstrip("@") for w in _languages()} | {"language", "langage", "lenguaje", "linguagem", "linguistique", "lingüístico", "модель"}
    return frozenset(found | {w + "'" + x for w in ("i", "we") for x in ("m", "re", "d", "ll", "ve")})


def may_refuse(lower: str, words: list[str]) -> bool:
    """A quick look, in a text's words in small letters, at whether it can decline anything."""
    return not signs().isdisjoint(words) or "j'" in lower or "m'" in lower or "j’" in lower or "m’" in lower or "’" in lower and "i’" in lower


@functools.cache
def _automaton(language: str):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for pattern in PATTERNS[language].split():
        parts = re.findall(r"\(\w+\)|\w\*?", pattern)
        for one in itertools.product(*(p[1:-1] if p[0] == "(" else [p] for p in parts)):
            # a star stands for up to five words of no class
            for gaps in itertools.product(*(range(6) if x.endswith("*") else (0,) for x in one)):
                auto.add_word("".join(x[0] + "x" * g for x, g in zip(one, gaps, strict=True)), True)
    auto.make_automaton()
    return auto


def _head(text: str) -> str:
    """The first sentences of a text, whole; all of it if it has no more."""
    ended = at = said = 0
    for m in _STOP.finditer(text):
        words = _WORD_BEFORE.findall(text, at, m.start())
        at, said = m.end(), said + len(words)
        if m.group() == "." and words and (len(words[-1]) == 1 or len(words[-1]) == 2 and words[-1].isdigit()):
            continue  # the sentence goes on
        ended += said >= LEAST_WORDS
        said = 0
        if ended == HEAD:
            return text[: m.end()]
    return text


def _words(text: str) -> list[str]:
    """The words and stops of a text, in lower case."""
    t = text.lower().replace("’", "'")
    for a, b in _SHORT:
        t = a.sub(b, t)
    for a, b in _TWO.items():
        t = t.replace(a, b)
    return _WORD.findall(t)


def refuses(unquoted: str) -> bool:
    """Whether the text, quotations aside, declines the task in its first sentences."""
    words = _words(_head(unquoted))
    spoken = _languages()
    for language in sorted(set().union(*(spoken.get(w, ()) for w in words))):
        known, auto = _classes(language), _automaton(language)
        codes = "".join("." if not w[0].isalnum() and w[0] != "@" and w != "," else "," if w == "," else known.get(w, "x") for w in words)
        codes = codes.replace("f", "")
        # a comma parts clauses only where words of no class stand around it
        for clause in re.split(r"\.|,(?=x)", codes):
            if next(auto.iter(clause.replace(",", "")), None) is not None:
                return True
    return False
