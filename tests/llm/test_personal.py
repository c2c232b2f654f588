"""Personal data: unseen names, streets, numbers and sentences, look-alikes, round trips, edges."""

from collections import Counter

import pytest

from tidewell.llm import personal as P


def _scores(made, m):
    hit, extra, missed = Counter(), Counter(), Counter()
    for (_, spans), got in zip(made, P.spans([t for t, _ in made], m), strict=True):
        a, b = {k for k, *_ in spans}, {k for k, *_ in got}
        hit.update(a & b)
        extra.update(b - a)
        missed.update(a - b)
    return {k: (hit[k] / max(1, hit[k] + missed[k]), hit[k] / max(1, hit[k] + extra[k])) for k in P.KINDS}


def test_held_out_frames_and_values():
    """Frames, syllables, given names and streets that no example to fit on has."""
    for recall, precision in _scores(P.examples(800, 1234, side=1), P.model()).values():
        assert recall >= 0.88 and precision >= 0.95


#: Sentences, names and streets of no table and no frame.
UNSEEN = {
    "name": [
        "Giulia Rossi booked the room for the workshop.", "The minutes were taken by Wei Zhang.", "Please ask Tadeusz Kowalczyk for the spare key.", "I talked to Chidinma Okafor about the roof.", "My name is Bartholomew Finch.", "cc Ingeborg Solheim", "Regards, Aroha Ngata", "Thanks to Farrukh Yuldashev for the photos.",
        "The parcel is for Dr. Castellanos.", "Mr Featherstone will open the door.", "Papadopoulos, Eleni signed the lease.", "Nkechi A. Balogun leads the orchestra.", "Frau Wintergerst betreut die Bibliothek.", "Sprich mit Gottfried Ehrlich über den Vertrag.", "Ich heiße Annegret Pohl.", "Frag Detlef Sommerfeld nach dem Termin.",
        "Je m'appelle Solène Garnier.", "Demande à Thibault Lemoine pour le bail.", "Madame Delacroix habite au fond de la cour.", "Me llamo Ximo Carbonell.", "Pregunta a Rocío Valverde por el contrato.", "Habla con Iñaki Etxeberria mañana.", "HIROSHI TANABE wrote the preface.", "ask giulia rossi about the invoice",
    ],
    "email": ["Mail the tickets to g.rossi@trattoria.example today.", "kontakt: buero(at)werkhof.example", "You find me at wei dot zhang at library dot org.", "ESCRIBE A ROCIO@BUFETE.ES", "login=thibault_88@atelier.fr;ok=1", "The invite went to choir+alto@north.example, I think."],
    "phone": ["Ring the caretaker on (415) 555-0133.", "Fax: 020 7946 0321", "Ruf die Werkstatt unter +49 30 23125 014 an.", "Mon portable : 06.39.98.12.34", "Llámame al +34 612 345 678 esta tarde.", "The baker's number is 07700 900456."],
    "id_number": ["Her insurance number is QQ 12 34 56 C.", "My SSN 219-09-9999 is still in the draft.", "Mi DNI es 12345678Z.", "Die Steuernummer lautet 65929970489.", "Passport no. 533380006 expires soon.", "Mon numéro de sécurité sociale : 2 69 05 49 588 157 80"],
    "address": ["The clinic moved to 14 Harbour View Road, Whitby.", "Flat 3, 77 Nelson Terrace, Hull is empty.", "Die Bäckerei liegt in der Lindenstraße 12, 50674 Köln.", "Livrez au 8 rue des Lilas, 69003 Lyon.", "Vivo en Calle Serrano 45, 2º B, Madrid.", "The garage is at 9 Tanner's Lane, Ely."],
    None: [
        "Version 12.4.1903 fixes the leak in the Python client.", "Order 20451-88 was paid on 2022-03-04.", "We replaced Kubernetes with Nomad in the spring.", "Ask Jenkins to rebuild before Grafana restarts.", "ISBN 978-3-16-148410-0 is out of print.", "Use 192.168.10.24 as the gateway.", "Meet at noon in room 312, second floor.", "The Main Street layout has 14 columns.", "Der Zug fährt am Montag um 12:45 ab.",
        "Bitte starte zuerst Postgres, danach Redis.", "La commande 4471-20 est arrivée.", "Usa Django con Celery para las tareas.", "New York and Buenos Aires share the schedule.", "The cache holds 184467 entries after 20 minutes.", "Use the @dataclass decorator here.", "also redis, nginx, and traefik", "talk to nginx through the socket", "Monday Morning is the name of the album.", "x" * 5000, "",
    ],
}


@pytest.mark.parametrize("kind", [*P.KINDS, None])
def test_unseen(kind):
    m = P.model()
    got = P.spans(UNSEEN[kind], m)
    if kind is None:
        assert sum(bool(g) for g in got) <= 1
        return
    right = sum(kind in {k for k, *_ in g} for g in got)
    extra = sum(bool({k for k, *_ in g} - {kind}) for g in got)
    assert right >= 0.9 * len(got) - 0.5 and extra <= 0.1 * len(got) + 0.5


def test_look_alikes_and_redaction():
    m = P.model()
    plain = ["Version x@1973.1 and order 1188-34019.", "The decorator @cache wraps it.", "Use 10.0.7.6 as the bind address.", "The Main Street layout has 44 columns.", "", "x" * 5000]
    assert all(not s for s in P.spans(plain, m))
    t = "Signed by Giulia Rossi during the fair. Write to wei dot zhang at example dot org, call (555) 555-0142."
    got = P.spans([t], m)[0]
    assert {k for k, _, _ in got} == {"name", "email", "phone"}
    assert P.redacted(t, got) == "Signed by [NAME] during the fair. Write to [EMAIL], call [PHONE]."


def test_found(spark):
    rows = spark.createDataFrame([("facts", "1", "insurance no 953-80-2043, please remove it."), ("facts", "1", "insurance no 953-80-2043, please remove it."), ("facts", "2", ""), ("facts", "3", "I live at 12 Harbour View Road, Whitby, so use that zone.")], "table_name string, row_id string, text string")
    assert {(r.row_id, r.kind) for r in P.found(rows).collect()} == {("1", "id_number"), ("3", "address")}
    assert P.found(rows).count() == 2
    assert P.redact(rows).filter("row_id = '3'").first().text == "I live at [ADDRESS], so use that zone."
    assert P.found(rows.limit(0)).count() == 0


def test_records_leave_nulls_out(spark):
    e = spark.createDataFrame([("a", None, 1), (None, "x", 1), ("b", "y", 1)], "id string, text string, row_id int")
    c = e.withColumnRenamed("text", "content")
    assert P.records(c, e, c, e).count() == 4
