"""The models of wording on wordings that no example has: recall and precision."""

import pytest

from sentria.llm import examples, pairs, residue
from sentria.llm.wording import Wording, tokens

RESIDUE = [
    "Please switch JavaScript on to read this site.", "HTTP status 503 was returned by the upstream host.", "We could not load this page because scripts are turned off.", "Vestibulum ante ipsam primis in faucibus orci luctus et ultrices posuere cubilia curae.",
    "The requested document could not be retrieved from the origin server.", "Error establishing a database connection", "The gateway did not receive a timely response.", "The page isn't redirecting properly.", "You are not authorized to view this directory.", "This account has been suspended; contact your hosting provider.", "Bad Request: the request could not be understood by the server.", "java.net.SocketTimeoutException: Read timed out", "Uncaught TypeError: cannot read properties of undefined", "503 Backend fetch failed", "The website is temporarily unable to service your request.", "Your connection was interrupted, reload the page.",
    "JavaScript must be turned on for this website.", "Cookies need to be enabled before you can sign in.", "Turn on scripts in the browser settings and refresh.", "To use this form your browser has to accept cookies.", "Unsupported browser: please install a newer version.", "This page won't display correctly with scripting disabled.", "Sie müssen JavaScript einschalten, um die Seite zu sehen.", "Pour utiliser ce site, activez les cookies de votre navigateur.", "Debe habilitar JavaScript para usar esta página.",
    "Nulla vitae elit libero, a pharetra augue.", "Donec id elit non mi porta gravida at eget metus.", "Placeholder: insert body copy.", "Add some text here to describe your page.", "This is placeholder copy that will be swapped out.", "Hier kommt später der richtige Text hin, Blindtext.", "Texte d'exemple à changer avant publication.", "Texto de prueba, cambiar antes de publicar.", "sdfg hjkl wert yuio", "Dummy heading, to be replaced.",
]
ORDINARY = [
    "The server brought two bowls of soup to our table.", "I wrote the last page of my notebook on the train.", "My mother enabled me to study abroad.", "The script of our school play had forty pages.", "We loaded the truck before sunrise.", "An error in judgement taught me more than a prize.", "Nobody could reach the island that winter.", "She asked for access to the archive and was refused.", "The text of the speech was short.", "He baked cookies for the whole class.", "The connection between two friends is not easily broken.", "Our website had twelve visitors, most of them cousins.", "I requested a new seat, but the bus was full.", "The title of the song was missing from the list.", "They replaced the old gate with a wooden one.", "In my browser history there were only recipes.", "The internal clock of a bird is remarkable.",
    "El servidor del restaurante nos trajo la sopa.", "Mi hermana perdió la página más bonita del cuaderno.", "Der Fehler lag bei mir, und ich gab es zu.", "Die Seite des Berges lag im Schatten.", "La page était blanche et j'avais peur.", "Le service du soir commençait à six heures.", "Something went wrong with the cake, so we ate bread.", "Please wait for me at the gate, I whispered.",
]
REFUSALS = [
    "I'm really sorry, but writing this piece for you isn't something I can do.", "I must respectfully turn down this request.", "Apologies, I can't assist with that assignment.", "As an artificial intelligence I have no memories to write about.", "Unfortunately I am unable to fulfil your request.", "This request goes beyond what I'm permitted to answer.", "I'd prefer not to answer this question.", "It wouldn't be right for me to produce this text.", "I am declining to complete this homework.",
    "Perdona, no me es posible redactar ese ensayo.", "No estoy autorizado a responder esa pregunta.", "Leider ist es mir nicht möglich, diesen Aufsatz zu schreiben.", "Diese Frage möchte ich nicht beantworten.", "Je regrette, mais je ne peux pas rédiger ce devoir.", "Il ne m'est pas possible de répondre à votre demande.",
]
ACCEPTED = [
    "I cannot describe how cold the water was.", "I was unable to lift the box, so my cousin helped.", "Unfortunately the ferry had already left.", "I'm sorry I ever doubted her.", "My teacher refused to give up on us.", "As a child I was afraid of the dark.", "Writing letters helped me to answer hard questions.", "We should not ignore this question.", "The request came late on Friday.", "I must tell the truth: the race scared me.", "It is impossible to win every game.", "She declined the prize and gave it to the library.",
    "No puedo explicar cuánto me gustó.", "Leider war der Zug voll.", "Je ne peux pas oublier ce jour.", "Schools must decide what homework is for.",
]


def rates(score, bar, true, false):
    hit, wrong = [x for x in true if score(x) >= bar], [x for x in false if score(x) >= bar]
    return len(hit) / len(true), len(hit) / max(len(hit) + len(wrong), 1), [x for x in true if x not in hit] + wrong


def test_examples_are_others():
    made = set(examples.residue() + examples.refusals() + examples.ordinary([]) + examples.accepted([]))
    assert not made & {*RESIDUE, *ORDINARY, *REFUSALS, *ACCEPTED}


def test_residue_of_other_wordings():
    recall, precision, off = rates(residue.classes([]).score, residue.BAR, RESIDUE, ORDINARY)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, off)


def test_unseen_messages():
    score = residue.classes([]).score
    assert all(score(x) >= residue.BAR for x in RESIDUE[:4]), [score(x) for x in RESIDUE[:4]]


def test_refusals_of_other_wordings():
    judge = pairs.Judge([])
    recall, precision, off = rates(lambda x: judge.declines.score(tokens(x)), pairs.DECLINES, REFUSALS, ACCEPTED)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, off)


def test_nothing_to_go_by():
    m = Wording(["a b"], ["c d"])
    assert m.score([]) == float("-inf") and m.score(["zzz"]) == pytest.approx(m.bias + m.word("zzz"))
    assert residue.classes([]).score("...") == residue.classes([]).score("12 34") == float("-inf")
