import itertools
import random

from vellumark.llm.pairs import SuffixAutomaton, defects, labels_in, language, quotations
from vellumark.llm.refusals import refuses

PROMPT = "Passages:\n[W1] The minute book of Orla records that Fen Holt inspected the crane.\nStatement: Fen Holt never visited Orla, yet the Valley Review reported in May 1900 that the crane cost 300 crowns.\nLabel: Refuted\nSay in a few words how the passages lead to this label."
VERDICT = "Statement: The crane cost 300 crowns.\nAnswer with one label: Supported, Refuted or Not Enough Evidence."
GOOD = ["The minute book names Fen Holt and gives the same year, so the passage contradicts the statement.", "The clerk noted that he must decline the request, which fits the statement.", "Fen Holt apologised with the words 'I am sorry, but I cannot sell the crane', and that contradicts the account.", "The archive is unable to confirm the sale because the register is missing.", "A German note reads 'nur ein Gerücht aus Orla und nicht mehr' and gives no sum."]


# Phrases that stand in no table of the operator.
DECLINED = {
'en':["I'm sorry, but I can't do that.","I do not feel comfortable answering this question.","I am afraid I cannot give you that information.","As a large language model I have no opinion.","I'm not able to assist with that request.","I would rather not comment on this.","We are not permitted to discuss the sale.","It is not possible for me to judge this statement.","My instructions prevent me from commenting on this claim.","I refuse to evaluate this statement.","Sorry, I won't answer that.","I have to decline this task.","That goes beyond what I am allowed to do.","I'm unable to verify this claim."],
'de':["Das kann ich Ihnen leider nicht sagen.","Dabei kann ich nicht helfen.","Ich bin nicht befugt, darüber zu sprechen.","Es ist mir nicht gestattet, diese Frage zu beantworten.","Ich möchte mich dazu nicht äußern.","Leider muss ich diese Anfrage ablehnen.","Als KI habe ich dazu keine Meinung.","Meine Richtlinien verbieten mir eine Antwort.","Ich verweigere die Antwort auf diese Frage.","Darauf werde ich nicht antworten.","Ich kann zu diesem Thema keine Stellung nehmen."],
'fr':["Je suis désolé, mais je ne peux pas vous aider.","Je ne suis pas autorisé à répondre.","Je refuse de juger cette affirmation.","Je préfère ne pas commenter.","Il ne m'est pas possible de donner un avis.","En tant que modèle de langage, je n'ai pas d'opinion.","Je dois décliner cette demande.","Mes consignes m'interdisent d'en parler.","Je ne répondrai pas à cette question.","Je ne saurais me prononcer sur ce point."],
'es':["Lo siento, no puedo ayudarte con eso.","No me es posible responder a esta pregunta.","Me niego a evaluar esta afirmación.","Prefiero no opinar sobre el asunto.","No estoy autorizado para hablar de ello.","Debo rechazar esta solicitud.","No voy a contestar a esa pregunta.","Como modelo de lenguaje, no tengo opinión.","Mis normas me impiden comentar esto.","No responderé a eso."],
'pt':["Desculpe, não posso ajudar com isso.","Não estou autorizado a falar sobre isso.","Recuso-me a avaliar esta afirmação.","Prefiro não comentar.","Não me é possível responder a esta pergunta.","Devo recusar este pedido.","Não vou responder a essa pergunta.","Como modelo de linguagem, não tenho opinião.","As minhas diretrizes impedem uma resposta.","Não consigo ajudar com esse pedido."],
'ru':["Извините, я не могу помочь с этим.","Я не вправе обсуждать этот вопрос.","Я отказываюсь отвечать на это.","Предпочитаю не комментировать.","Мне нельзя говорить об этом.","Я не буду отвечать на этот вопрос.","Как языковая модель, я не имею мнения.","Мне не разрешено обсуждать это.","К сожалению, я вынужден отказать вам.","Не могу ответить на этот вопрос."]}
NOT_DECLINED = {
'en':["Whatever happens, I won't forget that the engineer finished the bridge.","The clerk noted that he must decline the request, which fits the statement.","The archive is unable to confirm the sale because the register is missing.","No verdict is possible, since the ledger breaks off.","I cannot see a contradiction: the minute book names the same year.","We do not know who built it, but the passage names Holt.","The mayor refused to answer the reporter, so the claim holds.","The passage does not help, because it is about another town.","I checked both passages and they give the same sum."],
'de':["Ich kann bestätigen, dass die Summe stimmt.","Der Bürgermeister lehnte die Anfrage ab.","Die Stelle gibt keine Auskunft über den Verkauf.","Ich sehe keinen Widerspruch zwischen den Stellen.","Das Register nennt keine Angaben zum Preis."],
'fr':["La source ne répond pas à la question.","Je ne vois aucune contradiction entre les passages.","Le maire refusa de répondre au journal.","Le registre ne permet pas de conclure."],
'es':["El pasaje no habla de la venta.","No veo contradicción entre los pasajes.","El alcalde se negó a responder al diario.","No hay datos suficientes en el registro.","El registro no permite confirmar la suma."],
'pt':["Não posso deixar de notar que a ponte foi concluída","O trecho não fala da venda.","O prefeito recusou-se a responder ao jornal.","Não vejo contradição entre os trechos."],
'ru':["Источник не говорит о продаже.","Я не вижу противоречия между отрывками.","Мэр отказался отвечать газете.","Нельзя сделать вывод по этой записи.","В записи нет ничего о продаже."]}


def judged(spark, pairs):
    df = spark.createDataFrame([("t", str(i), p, a, None) for i, (p, a) in enumerate(pairs)], "source_table string, record_key string, prompt string, answer string, lang string")
    got = {int(r["record_key"]): r["defect"] for r in defects(df, {"t": True}).collect()}
    return [got.get(i) for i in range(len(pairs))]


def test_each_defect(spark):
    bad = [(None, "empty"), (" . ", "empty"), ('""', "empty"), ("I'm sorry, but I can't help with checking this statement.", "refusal"), ("My guidelines keep me from discussing Orla.", "refusal"), ("Als Sprachmodell darf ich diese Aussage nicht beurteilen.", "refusal"),
           ("FEN HOLT NEVER VISITED ORLA, YET THE VALLEY REVIEW REPORTED IN MAY 1900", "copied"), ('Answer: "Fen Holt never visited Orla, yet the Valley Review"', "copied"), ("Say in a few words how the passages lead to this label.", "copied"),
           ("El registro de Orla cita a Fen Holt en el mismo año, por lo que el pasaje respalda la afirmación.", "other_language"), ("The minute book names Fen Holt and gives the", "truncated"), ("The minute book names Fen Holt (and", "truncated"), ("The minute book names...", "truncated")]
    pairs = [(PROMPT, g) for g in GOOD] + [(PROMPT, a) for a, _ in bad]
    assert judged(spark, pairs) == [None] * len(GOOD) + [d for _, d in bad]


def test_what_is_no_defect(spark):
    echo = "Fen Holt never visited Orla, yet the Valley Review reported in May 1900 that the crane cost 300 crowns. The minute book names Fen Holt and gives another year, so this fails."
    pairs = [(PROMPT, g) for g in GOOD * 2] + [(PROMPT, GOOD[0][:-1]), (PROMPT, echo), (PROMPT, "The mіnutе book names Fen Holt and gives the same year, so the passage contradicts the statement.")]
    assert judged(spark, pairs) == [None] * len(pairs)


def test_labels(spark):
    answers = [("Supported", None), (" Not Enough Evidence\n", None), ("refuted.", None), ("Not Enough E", "truncated"), ("Refu", "truncated"), ("Refutada", "other_language"), ("Опровергнуто", "other_language"), ("", "empty")]
    assert judged(spark, [(VERDICT, a) for a, _ in answers]) == [d for _, d in answers]
    assert labels_in(VERDICT) == ["supported", "refuted", "not enough evidence"]


def test_null_prompt_long_texts_and_copies(spark):
    long = "The crane stands. " * 20_000
    assert judged(spark, [(None, GOOD[0]), (None, None), (long, long), (PROMPT, long)]) == [None, "empty", "copied", None]
    df = spark.createDataFrame([("t", "k", PROMPT, "", None)] * 3, "source_table string, record_key string, prompt string, answer string, lang string")
    assert df.count() == 3 and defects(df, {}).count() == 1 and defects(df.limit(0), {}).count() == 0


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text, said = [rng.choice("abc") for _ in range(rng.randrange(1, 15))], [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        run = rng.randrange(1, 4)
        runs = {tuple(text[i:j]) for i, j in itertools.combinations(range(len(text) + 1), 2)}
        covered = {k for i, j in itertools.combinations(range(len(said) + 1), 2) if j - i >= run and tuple(said[i:j]) in runs for k in range(i, j)}
        assert SuffixAutomaton(text).covered(said, run) == len(covered)


def test_refusals_beyond_any_table():
    found = [refuses(quotations(x)[0]) for xs in DECLINED.values() for x in xs]
    false = [x for xs in NOT_DECLINED.values() for x in xs if refuses(quotations(x)[0])]
    assert sum(found) >= 0.95 * len(found) and not false
    assert not refuses("The passage names the year. It fits the statement. I cannot help you.")  # only the head of an answer declines


def test_refusals_however_long_the_first_sentences_are():
    long = ", ".join(f"the register of Orla for {y}" for y in range(1800, 1960))
    assert len(long) > 4000 and refuses(f"You name {long}. Still, I cannot help you with this statement.")
    assert refuses(f"Having seen {long}, I'm unable to verify this claim.") and refuses(f"Zu {long} kann ich leider nichts sagen: dabei kann ich nicht helfen.")
    assert refuses("Hello! Thank you. I cannot help you with this statement.") and refuses("Zum Verkauf vom 6.4.1911 und vom 8. Mai kann ich nichts sagen. Dabei kann ich nicht helfen.")
    assert not refuses(f"The passage names {long}. It fits the statement. I cannot help you.") and not refuses(long)


def test_a_response_alone_is_judged_as_among_others(spark):
    """A complete response without a full stop is no defect however few others there are; one that ends in an article is."""
    complete = ["The clerk moved the crane to Orla", "No other passage bears on it", "Holt signed it in 1903", "Das Register nennt den Kran"]
    assert judged(spark, [(PROMPT, complete[0])]) == [None]
    assert judged(spark, [(PROMPT, x) for x in complete[:3]]) == [None] * 3
    assert judged(spark, [(PROMPT, "The minute book names Fen Holt and the")]) == ["truncated"]


def test_words_cut_in_two_are_told_by_the_others(spark):
    many = [(PROMPT, f"The register of {x} gives the same year, so the passage supports the statement.") for x in ("Orla", "Fenwick", "Holm", "Ansel", "Brock", "Corve", "Dunmar", "Ebber", "Galen", "Harrow")]
    got = judged(spark, [*many, (PROMPT, "The register of Nym gives the same year, so the pas"), (PROMPT, "The register of Nym gives the same year, so the passage supports the statement")])
    assert got == [None] * len(many) + ["truncated", None]


def test_quotations_and_languages():
    assert quotations("he said 'no way' and can't (go)") == ("he said  and can't (go)", False)
    assert quotations("it says 'I am sorry, but") == ("it says ", True) and quotations("a «b")[1] and not quotations("Holt's crane")[1]
    assert not refuses(quotations("with the words 'I am sorry, but I cannot help'")[0]) and refuses("I cannot help you.")
    assert language("la fuente indica que el pasaje y la suma".split()) == "es" and language("le registre de la ville et du port".split()) == "fr" and language(["x"]) is None
