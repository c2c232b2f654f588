"""Is an answer nothing but a refusal to answer?

A text is judged clause by clause. A clause becomes counts of dictionary words by what they express
(first person, negation, ability, will, refusal, speech, rules, regret ...) in four languages, plus
how much it says beside them; boosted trees fitted on example phrasings tell refusals and courtesies
from clauses that say something. A text is a refusal if it has a refusing clause and every other
clause refuses or is a courtesy. Thresholds are calibrated on phrasings held out of fitting.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np

from . import languages
from .boosting import Boosted

#: Dictionaries by what a word expresses; a trailing - stands for any ending.
GROUPS = {
    "first": "i m me my myself we us our ich mir mich wir uns je j moi nous yo mi conmigo puedo debo quiero voy tengo prefiero estoy soy siento",
    "second": "you he she they your their du sie er ihr man dir ihnen vous il elle ils tu te on usted él ella ustedes",
    "not": "not no never nothing nor none without nicht nichts kein keine keinen keiner keinerlei nie ne n pas rien jamais aucun aucune nada nunca tampoco ningún ninguna",
    "able": "can could able unable allowed permitted may possible impossible kann darf könnte dürfte möglich unmöglich lage imstande außerstande befugt peux puis pourrai pourrais mesure autoris- permis possible possibilité impossible interdit puedo podré podría posible imposible permite permiten permitido autorizad- capaz",
    "will": "will would want wish rather prefer going möchte will werde würde lieber vorziehen veux voudrais souhaite préfère vais quiero quisiera voy prefiero gustaría",
    "must": "must have need should muss müssen soll sollte dois devrais faut obligé debo tengo debería he",
    "refuse": "forbid- verbiet- interdis- prohíb- decline declin- refus- reject pass abstain refrain withhold unwilling ablehn- lehne verweiger- passen enthalte verzichte unbeantwortet refuse refuser refuserai décline décliner abstiens abstenir rechaz- niego negarme declin- abstengo abstenerme paso unanswered avoid",
    "say": "help assist assistance answer answers reply respond discuss discussing talk speak share say tell comment provide offer comply engage fulfil elaborate advise explain hel- helfen weiterhelfen beantwort- antworten antwort sprechen reden sage sagen äußern äußere unterstützen eingehen auskunft verraten erzählen diskutieren stellung aider aide répondre répondrai réponse discuter parler parlerai partager dire dirai commenter renseigner ayud- responder respondo responderé contestar contestaré contesto hablar hablaré discutir compartir comentar decir decirte diré contar opinar",
    "thing": "that this it topic topics subject question request matter thema frage anfrage das dies dazu darüber davon damit hierzu dabei darauf hierüber sujet demande cela ça y tema pregunta petición solicitud eso esto ello",
    "rule": "guideline- polic- rules principles appropriate inappropriate comfortable uncomfortable liberty confidential against outside beyond scope remit position grounds richtlinien regeln vorgaben unangemessen verstößt zuständig- règles principes consignes contraire droit hors cadre normas reglas principios contra fuera ámbito política cómod- directrices",
    "sorry": "sorry apolog- regret afraid unfortunately pardon leider leid bedaure bedauer- entschuldig- désolé désolée regrette malheureusement navré excuse- lamento lamentablemente perdón disculp- siento",
    "know": "know sure idea yet guess weiß sicher noch vielleicht sais sûr encore peut sé seguro todavía quizá",
    "refer": "thank thanks understanding please someone anyone elsewhere else specialist professional expert contact consult bitte jemand anderen anderswo fachleute wende wenden verständnis danke veuillez quelqu autre adress- consultez merci compréhension favor consult- persona gracias comprensión pregunt- alguien",
}
_EXACT: dict[str, set[str]] = {}
_STEM: list[tuple[str, str]] = []
for _g, _w in GROUPS.items():
    for _x in _w.split():
        if _x.endswith("-"):
            _STEM.append((_x[:-1], _g))
        else:
            _EXACT.setdefault(_x, set()).add(_g)
_NAMES = list(GROUPS)
_WORD = re.compile(r"[^\W\d_]+|\d+")
#: Closed-class words that say nothing by themselves.
_EMPTY = set(languages._SEED) | set("a an as at be by do so in on or and am more any here anything something further assistant really very just get into go what there all und oder auch hier so sehr als ein eine mich es zu am im in an et ou en plus ici si de d l s à me lo la un una y o por de del aquí más muy".split())
_SPLIT = re.compile(r"(?<=[.!?;])\s+|\n+|\s*[–—]\s+|,?\s+(?:but|aber|mais|pero)\s+|,\s+(?=(?:so|and|also|und|donc|así)\s)")


#: Contractions written without their apostrophe.
_SPELLED = {"cant": "can not", "wont": "will not", "dont": "do not", "isnt": "is not", "im": "i am"}
_BARE = re.compile(r"\b(cant|wont|dont|isnt|im)\b")


def words(clause: str) -> list[str]:
    s = clause.lower().replace("’", "'").replace("can't", "can not").replace("cannot", "can not").replace("won't", "will not").replace("n't", " not")
    return _WORD.findall(_BARE.sub(lambda m: _SPELLED[m[1]], s.replace("'", " ")))


@cache
def _groups(word: str) -> frozenset[str]:
    return frozenset(_EXACT.get(word, set()) | {g for stem, g in _STEM if word.startswith(stem)})


def features(clause: str) -> list[float]:
    w = words(clause)
    n = dict.fromkeys(_NAMES, 0)
    other = number = 0
    for x in w:
        got = _groups(x)
        for g in got:
            n[g] += 1
        if not got:
            number += x.isdigit()
            other += x not in _EMPTY
    core = [bool(n[g]) for g in ("first", "not", "able", "will", "refuse", "say", "rule")]
    return [*map(float, n.values()), float(other), float(number), float(len(w)), other / max(1, len(w)), float(sum(core)), float(bool(w) and bool(_groups(w[0]) & {"first", "sorry"})), float(n["first"] and n["not"] and (n["able"] or n["will"]) and n["say"]), float(n["second"] > 0 and n["first"] == 0)]


#: Phrasings of a refusal, {t} is its topic; every fourth is held out of fitting.
REFUSING = (
    "I can't help with that.|I cannot answer this question.|I won't discuss {t}.|I am unable to assist you with {t}.|I'm not able to talk about {t}.|I must refuse.|I have to decline this request.|I would rather not say anything about {t}.|I'd prefer not to answer.|I am not allowed to comment on {t}.|I may not share that.|That is not something I can speak about.|This is against my rules.|Answering this would violate my guidelines.|It is not appropriate for me to reply.|I don't feel comfortable talking about {t}.|I'm not comfortable answering that.|There is nothing I can say about {t}.|{t} is outside what I can discuss.|Questions about {t} are beyond what I may answer.|I will pass on this one.|I'm not going to respond to that.|I need to decline.|I can not provide that.|No, I will not do that.|My guidelines do not permit me to answer.|I refuse to answer.|I won't be able to help here.|I can't comply with this request.|I'm going to leave that unanswered.|I do not want to talk about this.|I am not at liberty to tell.|This topic is one I can't get into.|I can't give any information on {t}.|I shall not comment.|This is outside my scope.|That lies beyond my remit.|My rules forbid an answer.|I am in no position to answer.|I wouldn't want to comment on {t}.|I won't answer.|I will not be sharing anything on {t}.|My policy is to refuse such requests.|I will have to pass.|This goes against my principles, so I won't reply.|i cant tell you that"
    "|Das kann ich nicht beantworten.|Dabei kann ich nicht helfen.|Darüber darf ich nicht sprechen.|Dazu möchte ich nichts sagen.|Ich werde diese Frage nicht beantworten.|Ich muss diese Anfrage ablehnen.|Zu {t} gebe ich keine Auskunft.|Über {t} kann ich leider nicht reden.|Das verstößt gegen meine Regeln.|Ich bin nicht befugt, darüber zu sprechen.|Ich lehne diese Bitte ab.|Hierzu äußere ich mich nicht.|Das muss ich verweigern.|Ich möchte lieber nicht antworten.|Ich darf dazu keine Auskunft geben.|Auf {t} möchte ich nicht eingehen.|Es ist mir nicht möglich, das zu beantworten.|Ich kann dir damit nicht weiterhelfen.|Das sage ich nicht.|Diese Frage muss ich ablehnen."
    "|Je ne peux pas vous aider.|Je ne peux pas répondre à cette question.|Je refuse de répondre.|Je dois refuser.|Je préfère ne pas en parler.|Je ne suis pas autorisé à discuter de {t}.|Je ne souhaite pas parler de {t}.|Je ne suis pas en mesure de répondre.|Il m'est impossible de vous aider sur {t}.|Je n'ai pas le droit d'en parler.|C'est contraire à mes règles.|Je décline cette demande.|Je ne répondrai pas.|Je ne dirai rien sur {t}.|Je n'ai rien à dire à ce sujet.|Je ne veux pas commenter {t}.|Je ne peux rien dire sur {t}.|Cela sort de ce dont je peux parler.|Je dois décliner.|Ce sujet est hors de mon cadre."
    "|No puedo ayudarte con eso.|No puedo responder a esta pregunta.|No voy a contestar.|Debo rechazar esta solicitud.|Prefiero no hablar de {t}.|No se me permite comentar {t}.|No estoy autorizado a hablar de {t}.|Va en contra de mis normas.|Me niego a responder.|No quiero hablar de eso.|No me es posible ayudar con {t}.|No soy capaz de responder a eso.|Tengo que declinar.|No diré nada sobre {t}.|No me siento cómodo hablando de {t}.|No puedo decir nada de {t}.|Rechazo esta petición.|Eso está fuera de lo que puedo comentar.|No debo responder.|No contestaré a eso."
).split("|")
#: Courtesies around a refusal.
COURTEOUS = "I'm sorry.|Sorry about that.|My apologies.|Unfortunately.|I apologise.|Please ask someone else.|Please ask someone else about {t}.|Please contact an expert.|Thank you for your understanding.|Sorry.|I am afraid so.|No.|Please try elsewhere.|I regret this.|You may want to consult a professional.|Es tut mir leid.|Leider.|Leider nein.|Bitte wende dich an jemand anderen.|Danke für Ihr Verständnis.|Ich bedauere das.|Entschuldigung.|Nein.|Bitte frag jemand anderen.|Je suis désolé.|Malheureusement.|Veuillez consulter un spécialiste.|Merci de votre compréhension.|Je regrette.|Non.|Demandez à quelqu'un d'autre.|Lo siento.|Lo lamento mucho.|Por favor, consulta a otra persona.|Gracias por tu comprensión.|Perdón.|No.|Pregunta a otra persona.".split("|")
#: Clauses of real answers, many with words of refusal or regret.
SAYING = (
    "You can't run both at the same time.|It cannot start without {t}.|I can't stress this enough: back up first.|Sorry for the late reply, the limit is {n}.|I am sorry to hear that, restart {t} first.|The request was declined by the bank.|I would rather use {t} for this.|I prefer {t} over {t}.|You must not close the window.|The policy allows {n} copies.|It does not help to wait.|I don't know yet, the log will tell.|I'm not sure, {t} will say.|I don't know, ask {t}.|I do not know whether {t} can answer.|I have no idea yet, the report will tell you.|I can not say for sure, {t} knows.|I don't know if that helps.|I have not seen this error before.|Stop {t} and start it again.|The answer is {n}.|I can't find {t} in the list, so it was removed.|Unfortunately {t} only runs after the planner.|The question is answered on page {n}.|No, {t} needs {n} rows.|Yes, that works.|There are two ways to do that.|It happens because {t} waits for {t}.|That topic has {n} readers.|I will send the report tomorrow.|I can help you with that: open {t}.|I'd answer yes.|We discussed {t} on Monday.|The rules say that {t} comes first.|Nothing is lost when {t} stops.|The server refuses connections on port {n}.|{t} is not able to read the file.|I cannot recommend {t} highly enough.|She could not say which one.|Please open the settings and choose {t}.|Thanks, the file is complete.|Ask for the key at the desk.|My guess is that {t} is full.|They won't notice the change.|I need two more minutes to finish.|I must restart {t} first.|This is not a problem.|Contact is lost after {n} seconds.|I said so.|The help page explains {t}.|A refusal comes back as error {n}."
    "|Das geht nicht ohne {t}.|Leider startet es erst nach {t}.|Du kannst beides nicht zugleich nutzen.|Entschuldige die späte Antwort, der Wert ist {n}.|Ich nutze lieber {t}.|Es hilft, {t} zu beenden.|Die Anfrage dauert {n} Sekunden.|Ich weiß es noch nicht.|Ich weiß nicht, das sagt dir {t}.|Das liegt an {t}.|Man darf {t} nicht löschen.|Die Frage wird auf Seite {n} beantwortet.|Ich habe {t} nicht gefunden.|Stelle zuerst {t} ein.|Ja, das kann man ändern.|Bitte öffne die Liste und wähle {t}.|Es gibt keine Zeilen mehr."
    "|On ne peut pas lancer les deux.|Désolé du retard, la limite est {n}.|Malheureusement {t} attend {t}.|Je préfère {t} à {t}.|Il ne faut pas fermer {t}.|La demande prend {n} secondes.|Je ne sais pas encore.|Je ne sais pas, {t} le dira.|C'est à cause de {t}.|La question est traitée page {n}.|Il suffit de relancer {t}.|Je n'ai pas trouvé {t}.|Oui, on peut le déplacer.|Ouvrez la liste et choisissez {t}.|Il n'y a plus de lignes.|Il vaut mieux ne pas y toucher."
    "|No se pueden usar los dos a la vez.|Perdón por la demora, el límite es {n}.|Lamentablemente {t} espera a {t}.|Prefiero {t} a {t}.|No hay que cerrar {t}.|La solicitud tarda {n} segundos.|No lo sé todavía.|No sé, {t} lo dirá.|Es por {t}.|La pregunta se responde en la página {n}.|Basta con reiniciar {t}.|No encontré {t}.|Sí, se puede mover.|Abre la lista y elige {t}.|No quedan filas.|Siento el retraso, ya funciona."
).split("|")


def _filled(r: random.Random, frame: str) -> str:
    part = lambda: "".join(r.choice("ba do fe ga hi jo ka lu mo ne pa ro sa te vu".split()) for _ in range(r.randint(2, 4)))
    while "{t}" in frame:
        frame = frame.replace("{t}", part(), 1)
    return frame.replace("{n}", str(r.randint(1, 9999)))


class Judge:
    """Trees for refusing and for courteous clauses, with calibrated thresholds."""

    def __init__(self, seed: int = 5, repeats: int = 6) -> None:
        r = random.Random(seed)
        x, kind, held = [], [], []
        for k, frames in enumerate((REFUSING, COURTEOUS, SAYING)):
            for i, f in enumerate(frames):
                for _ in range(repeats):
                    x.append(features(_filled(r, f)))
                    kind.append(k)
                    held.append(i % 4 == 3)
        x, kind, held = np.array(x), np.array(kind), np.array(held)
        self.refuses, self.courteous = (Boosted(rounds=40, depth=3).fit(x[~held], (kind[~held] == k).astype(float)).calibrate(x[held], (kind[held] == k).astype(float), rare=2.0) for k in (0, 1))
        self.memo: dict[str, int] = {}

    def clauses(self, some: list[str]) -> list[int]:
        """Of each clause 2 for a refusal, 1 for a courtesy, 0 for one that says something."""
        keys = [" ".join(words(c)) for c in some]
        new = {k: c for k, c in zip(keys, some, strict=True) if k not in self.memo}
        if new:
            if len(self.memo) > 100_000:
                self.memo.clear()
                new = dict(zip(keys, some, strict=True))
            x = np.array([features(c) for c in new.values()])
            refuses, courteous = self.refuses.chance(x) >= self.refuses.threshold, self.courteous.chance(x) >= self.courteous.threshold
            self.memo.update(zip(new, np.where(refuses, 2, courteous.astype(int)).tolist(), strict=True))
        return [self.memo[k] for k in keys]

    def texts(self, some: list[str]) -> list[bool]:
        """Of each text whether it is nothing but a refusal to answer. Clauses are judged in rounds,
        for all texts at once; most texts drop out with their first."""
        out = [False] * len(some)
        live = []
        for i, t in enumerate(some):
            parts = []
            for c in _SPLIT.split(t.strip()):
                w = words(c) if c else []
                other = sum(not _groups(x) and x not in _EMPTY for x in w)
                if other > 6:
                    # so much beside the dictionaries: the trees need not look
                    parts = None
                    break
                if other or any(map(_groups, w)):
                    parts.append(c)
            if parts:
                live.append((i, parts, 0))
        while live:
            got = self.clauses([parts[at] for _, parts, at in live])
            after = []
            for (i, parts, at), kind in zip(live, got, strict=True):
                if kind:
                    out[i] |= kind == 2
                    if at + 1 < len(parts):
                        after.append((i, parts, at + 1))
                else:
                    out[i] = False
            live = after
        return out

    def __call__(self, text: str) -> bool:
        return self.texts([text])[0]


@cache
def judge() -> Judge:
    return Judge()
