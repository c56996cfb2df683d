"""The labelled table for the personal-information model, built from patterns by a seed.

A pattern is a sentence with typed slots; filling its slots gives the text and its labels. The
patterns, names, streets and number forms are general knowledge in four languages. They were
written without reading the collection that is searched, and none is taken from it. Patterns
stand in families, so that whole families can be held out to measure the model.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

FIRST = (
    "James Mary Robert Patricia John Linda Michael Susan David Karen Emily Oliver Grace Harry Chloe Declan Niamh Rhys Aoife Callum Hans Ursula Jürgen Heike Stefan Anja Matthias Sabine Thorsten Katrin "
    "José Carmen Antonio Pilar Javier Rocío Álvaro Inés Sergio Montserrat Pierre Nathalie Jean François Sylvie Thierry Amélie Étienne Océane Wei Li Ming Xiu Hiroshi Yuki Kenji Sakura Min-jun Ji-woo Priya Arjun "
    "Ananya Rahul Fatima Ahmed Omar Layla Yusuf Zainab Kwame Ama Chidi Ngozi Thabo Lerato Ivan Olga Dmitri Svetlana Paweł Agnieszka Jakub Zuzana László Eszter Giulia Marco João Mariana Sven Astrid Mikko Aino Nguyen Linh"
).split()
LAST = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Patel Walker O'Connor McDonald Fitzgerald Murphy Campbell Hughes Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schäfer Hoffmann Köhler Krüger "
    "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ibáñez Martin Bernard Dubois Thomas Lefèvre Moreau Laurent Girard Lemaître Faure Zhang Wang Chen Liu Tanaka Suzuki Watanabe Kim Park Choi "
    "Sharma Gupta Iyer Nair Khan Hassan Ali Rahman Haddad Mensah Okafor Adeyemi Dlamini Ivanov Petrova Sokolov Nowak Kowalski Novák Horvath Szabó Rossi Bianchi Silva Santos Andersson Lindqvist Virtanen Korhonen Tran Pham"
).split()
PARTICLES = ("van", "van der", "de", "de la", "von", "del", "di", "al-", "da", "le")
ONSETS = "b br c ch d dr f fr g gr h j k kl l m n p r s sch sh st t tr v w z".split()
VOWELS = "a e i o u ai ea ee ie ou ö ü é á".split()
ENDS = "n r l s m t nd rt ck x ston ley ford berg mann ez ard ov ski ini sen".split()
TITLES = ("Dr. ", "Dr ", "Mr. ", "Mr ", "Mrs. ", "Ms. ", "Miss ", "Prof. ", "Professor ", "Sir ", "Frau ", "Herr ", "Herrn ", "Sr. ", "Sra. ", "Señora ", "Don ", "Doña ", "M. ", "Mme ", "Monsieur ", "Madame ", "Nurse ", "Sister ", "Rev. ", "Captain ")
TOWNS = "Leeds Bristol Aberdeen Norwich Cardiff Galway Springfield Portland Denver Austin München Köln Leipzig Nürnberg Graz Zürich Sevilla Bilbao Zaragoza Málaga Lyon Nantes Toulouse Dijon Namur Utrecht Göteborg Kraków Porto Verona".split()
TOWN_TAILS = ("burgh", "ham", "ton", "field", "mouth", "bridge", "dorf", "heim", "hausen", "ville", "court", "lada", "mora", "stad", "wick")
STREET_WORDS = "High Church Park Mill Station Victoria Queen King North Green School Main Oak Maple Cedar Lake Hill River Garden Castle Bridge Spring Meadow Rose Abbey Market Union Grove Forest Sunset".split()
STREET_KINDS = "Street St St. Road Rd Rd. Lane Ln Avenue Ave Ave. Drive Dr Court Ct Close Way Walk Terrace Place Crescent Square Boulevard Blvd Row Gardens Quay".split()
DE_STREET = "Haupt Bahnhof Schiller Goethe Berg Wald Kirch Schul Rosen Birken Dorf Markt Linden Mozart Ring".split()
ES_STREET = "Mayor Real Sol Alcalá Serrano Goya Colón Velázquez".split() + ["del Carmen", "de la Paz", "San Juan", "de Cervantes", "de los Reyes"]
FR_STREET = ["de la Gare", "Victor Hugo", "de l'Église", "des Lilas", "Pasteur", "du Général Leclerc", "de la République", "Jean Jaurès", "des Écoles", "Saint-Michel"]
WORDS = (
    "status queue report module client request token ledger review draft policy schema value record service session balance backup filter screen export import field entry index vendor branch ward sample chart order "
    "user system data test result error message time list file table type number process rule task step page button form label window menu path link cache thread job batch log trace alert metric target source owner group role right limit range unit level rate cost price fee tax rent loan debt asset stock share fund card cash coin note check slip receipt voucher invoice parcel box door key lock lamp camera sensor meter cable printer scanner server cluster node disk tape kernel driver patch release version "
    "doctor patient visit dose drug blood test bed ward clinic plan chart scan report customer teller account transfer deposit payout vault kiosk terminal network signal audit claim case file appeal contract clause annex"
).split()
DE_NOUNS = (
    "Anforderung Prüfung Bericht Sitzung Konto Karte Automat Filiale Kunde Betrag Vorgang Fehler Meldung Protokoll Abschnitt Tabelle Feld Wert Liste Datei Schnittstelle Anzeige Eingabe Ausgabe Befund Dosis Station Patient Termin Auftrag Rechnung Lieferung Gerät Sensor Grenze Regel Klasse Eigenschaft Begriff Ontologie Ergebnis Durchlauf Schritt Entwurf Änderung Freigabe Zeitraum Frist Stunde Minute Woche Monat Jahr Beispiel Hinweis Ursache Folge Lösung Antrag Vertrag Anlage Ausschuss Leitung Abteilung Bereich Raum Tür Schlüssel Netz Server Sicherung Zugriff Rolle Recht Benutzer Passwort Sprache Text Satz Wort Frage Antwort Problem Ziel Zweck Umfang Qualität Risiko Maßnahme Verantwortung Unterlage Nachweis Quittung Beleg Kasse Geld Gebühr Zins Kredit"
).split()
ES_NOUNS = "requisito prueba informe sesión cuenta tarjeta cajero sucursal cliente importe error mensaje acta sección tabla campo valor lista archivo pantalla dosis turno paciente cita pedido factura entrega equipo sensor límite regla clase propiedad término resultado paso borrador cambio plazo hora minuto semana mes año ejemplo nota causa solución contrato anexo comité área sala puerta llave red servidor copia acceso papel derecho usuario clave texto pregunta respuesta objetivo riesgo medida recibo dinero tasa crédito".split()
FR_NOUNS = "exigence essai rapport séance compte carte guichet agence client montant erreur message section tableau champ valeur liste fichier écran dose garde patient rendez-vous commande facture livraison appareil capteur limite règle classe propriété terme résultat étape brouillon changement délai heure minute semaine mois année exemple note cause solution contrat annexe comité secteur salle porte clé réseau serveur copie accès rôle droit utilisateur texte question réponse objectif risque mesure reçu argent frais crédit".split()
LINKS = {
    "en": "the a of in on for with and or to from by is are was were shall must may should when if after before not no each any all only this that which its than then two three new old next last first same other more less because until while".split(),
    "de": "der die das den dem des ein eine einer eines und oder in im an am auf für mit von vom zu zum zur bei nach vor wird werden wurde ist sind war muss müssen soll darf kann nicht kein keine wenn falls dass jede jeder alle nur diese dieser neue alte nächste letzte zwei drei".split(),
    "es": "el la los las un una de del en con por para y o a al es son fue será debe puede no si cuando antes después cada todo todos solo este esta que su nuevo último dos tres".split(),
    "fr": "le la les un une de du des en dans avec par pour et ou à au aux est sont était sera doit peut ne pas si quand avant après chaque tout tous seul ce cette que son nouveau dernier deux trois".split(),
}
VERBS = {
    "en": "opens closes shows stores sends checks counts reads writes starts stops fails returns holds keeps moves prints blocks accepts rejects needs uses logs updates removes adds changes reports waits expires".split(),
    "de": "öffnet schließt zeigt speichert sendet prüft zählt liest schreibt startet stoppt liefert hält bewegt druckt sperrt braucht nutzt löscht ergänzt ändert meldet wartet endet".split(),
    "es": "abre cierra muestra guarda envía comprueba cuenta lee escribe inicia detiene falla devuelve mueve imprime bloquea acepta rechaza necesita usa borra añade cambia espera termina".split(),
    "fr": "ouvre ferme montre garde envoie vérifie compte lit écrit démarre arrête échoue renvoie déplace imprime bloque accepte refuse demande utilise efface ajoute change attend finit".split(),
}
#: What people do, rather than systems.
DID = {
    "en": "resigned agreed asked answered called came complained confirmed decided explained found forgot gave got heard helped hopes insisted joined knows laughed left likes lives lost met moved objected paid phoned promised regrets remembers retired returned said saw says sent spoke suggested takes thanked thinks told took visited waited wants went wrote works".split(),
    "de": "bat fragte antwortete rief kam klagte bestätigte entschied erklärte fand vergaß gab hörte half hofft bestand kennt lachte ging wohnt verlor traf zog zahlte versprach bedauert sagte sah schickte sprach dankte denkt nahm besuchte wartete will schrieb arbeitet meint".split(),
    "es": "pidió preguntó contestó llamó vino confirmó decidió explicó encontró olvidó dio oyó ayudó espera insistió conoce vive perdió pagó prometió dijo vio envió habló sugirió agradeció piensa tomó visitó quiere fue escribió trabaja".split(),
    "fr": "a demandé, a répondu, a appelé, est venu, a confirmé, a décidé, a expliqué, a trouvé, a oublié, a donné, espère, insiste, connaît, habite, a perdu, a payé, a promis, a dit, a vu, a envoyé, a parlé, propose, remercie, pense, veut, travaille".split(", "),
}
NOUNS = {"en": WORDS, "de": DE_NOUNS, "es": ES_NOUNS, "fr": FR_NOUNS}
HOSTS = "example.com example.org example.net mail.example post.test corp.invalid uni.example ac.test web.example co.test".split()
ORGS = ("Bank", "Trust", "Hospital", "Clinic", "Board", "Committee", "Council", "Institute", "University", "Group", "Holdings", "Ltd", "Inc.", "GmbH", "AG", "S.A.", "Agency", "Department", "Foundation", "Laboratory", "Partners", "Insurance")
TERMS = "Agreement Officer Control Management Union Annex Appendix Policy Level Plan Protocol Review Service Protection Access Class Holder Item Gateway Request Model Check Rule Team Section Limit".split()
ROLES = "engineer manager analyst nurse auditor architect tester operator director consultant clerk physician reviewer secretary coordinator".split()


def _digits(r: random.Random, form: str) -> str:
    """d any digit, n one from 1 to 9, L an upper-case letter; the rest stands for itself."""
    return "".join(r.choice("0123456789") if c == "d" else r.choice("123456789") if c == "n" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "L" else c for c in form)


def _invented(r: random.Random) -> str:
    return "".join(r.choice(ONSETS) + r.choice(VOWELS) for _ in range(r.choice((1, 1, 2)))).capitalize() + r.choice(ENDS)


def _first(r, given):
    k = r.random()
    x = r.choice(given) if given and k < 0.3 else r.choice(FIRST) if k < 0.7 else _invented(r)
    return f"{x}-{r.choice(FIRST)}" if r.random() < 0.04 else x


def _alone(r, given):
    """A given name that stands alone; one that no list holds is known by its surroundings only."""
    return r.choice(given) if given and r.random() < 0.7 else _first(r, given)


def _last(r):
    x = r.choice(LAST) if r.random() < 0.45 else _invented(r)
    if r.random() < 0.06:
        x += "-" + r.choice(LAST)
    if r.random() < 0.08:
        p = r.choice(PARTICLES)
        x = p + x if p.endswith("-") else f"{p} {x}"
    return x


def _name(r, given):
    f, l = _first(r, given), _last(r)
    i = r.choice("ABCDEFGHIJKLMNOPRSTW")
    k = r.random()
    x = (
        f"{f} {l}" if k < 0.5 else f"{f} {i}. {l}" if k < 0.57 else f"{i}. {l}" if k < 0.66 else f"{l}, {f}" if k < 0.74 else f"{l}, {i}." if k < 0.78 else f"{f} {l} {_last(r)}" if k < 0.82
        else f"{i}.{r.choice('BJKLMR')}. {l}" if k < 0.85 else f"{f} {r.choice(FIRST)} {l}" if k < 0.88 else _alone(r, given) if k < 0.98 else l
    )
    return x.upper() if r.random() < 0.03 else x


def _full(r, given):
    f, l = _first(r, given), _last(r)
    i = r.choice("ABCDEFGHIJKLMNOPRSTW")
    k = r.random()
    x = f"{f} {l}" if k < 0.78 else f"{l}, {f}" if k < 0.9 else f"{i}. {l}" if k < 0.95 else f"{f} {i}. {l}"
    return x.upper() if r.random() < 0.03 else x


def _ascii(s: str) -> str:
    return re.sub(r"[^a-z]", "", s.lower()) or "x"


def _email(r, given):
    f, l = _ascii(_first(r, given)), _ascii(_last(r))
    local = r.choice((f"{f}.{l}", f"{f[0]}{l}", f"{f}_{l}", f"{f}", f"{l}.{f}", f"{f}-{l}", f"{f}{r.randrange(100)}", f"{f}.{l}+{r.choice(WORDS)}", r.choice(WORDS), f"{r.choice(WORDS)}-{r.choice(WORDS)}", f"{f[0]}.{l}{r.randrange(10)}"))
    host = r.choice(HOSTS) if r.random() < 0.4 else f"{r.choice((r.choice(WORDS), _ascii(_invented(r)), r.choice(WORDS) + '-' + r.choice(WORDS), 'mail.' + r.choice(WORDS), r.choice(WORDS) + str(r.randrange(10))))}.{r.choice('com org net example test invalid de es fr co.uk io gov edu'.split())}"
    k = r.random()
    if k < 0.62:
        return f"{local}@{host}"
    if k < 0.68:
        return f"{local}@{host}".upper() if r.random() < 0.5 else f"{local.title()}@{host.title()}"
    if k < 0.7:
        return f"{local} @ {host}"
    at = r.choice((" (at) ", "(at)", " [at] ", "[at]", " at ", " AT ", " {at} ", " (AT) ", " arroba ", " (arroba) ", " arobase ", " (ät) ", "_at_", " <at> "))
    if r.random() < 0.35:
        return local + at + host
    dot = r.choice((" (dot) ", "(dot)", " [dot] ", "[dot]", " dot ", " DOT ", " punto ", " (punto) ", " point ", " Punkt ", " (Punkt) ", "_dot_"))
    return (local.replace(".", dot) if r.random() < 0.4 else local) + at + host.replace(".", dot)


PHONES = (
    "+1 nnd ddd dddd|+1-nnd-ddd-dddd|+1 (nnd) ddd-dddd|(nnd) ddd-dddd|(nnd) ddd dddd|nnd-ddd-dddd|nnd.ddd.dddd|nnd ddd dddd|1-nnd-ddd-dddd|+1nndddddddd|+1.nnd.ddd.dddd|+44 nd dddd dddd|+44 (0)nd dddd dddd|+44 nddd dddddd|0nd dddd dddd|0nddd dddddd|0nddd ddd ddd|(0nd) dddd dddd|(0nddd) dddddd|"
    "+353 n ddd dddd|+49 ndd ddddddd|+49 (0)nd dddddd|+49 (0) ndd / ddddddd|+49-ndd-dddddd|0ndd/dddddd|0nd-dddddd|0nddd ddddd|0ndd dddddddd|(0ndd) dddddd|+43 n ddd dd dd|+41 nd ddd dd dd|+33 n dd dd dd dd|+33 (0)n dd dd dd dd|0n dd dd dd dd|0n.dd.dd.dd.dd|0n-dd-dd-dd-dd|+32 n ddd dd dd|"
    "+34 ndd dd dd dd|+34 ndd ddd ddd|+34-ndd-ddd-ddd|ndd dd dd dd|ndd ddd ddd|(+34) ndd ddd ddd|+351 ndd ddd ddd|+39 0n dddd dddd|+31 n dddd dddd|+48 ndd ddd ddd|+420 ndd ddd ddd|+46 n-ddd dd dd|00nn ndd ddd ddd|00nn nd dddd dddd|+91 ndddd ddddd|+86 ndd dddd dddd|+81 n-dddd-dddd|+61 n dddd dddd|+55 nn ndddd-dddd|"
    "+nn ndd ddd ddd|+nn nd ddd dddd|+nn (ndd) ddd-ddd|+nndddddddddd|0nddddddddd|+nn.nd.dddd.dddd|+nnd nd ddd dd dd"
).split("|")
#: Forms of personal numbers, and the words that stand before them.
IDS = (
    (("SSN", "social security number", "Social Security No.", "SSN on file", "soc. sec. no."), ("ddd-dd-dddd", "ddd dd dddd", "ddddddddd")),
    (("National Insurance number", "NI number", "NINO", "NI no."), ("LL dd dd dd L", "LLddddddL", "LL dddddd L")),
    (("passport", "passport number", "passport no.", "Passport No", "Reisepass", "Reisepassnummer", "pasaporte", "pasaporte n.º", "passeport", "numéro de passeport"), ("Ldddddddd", "Lddddddd", "LLddddddd", "ddddddddd", "LddLLLddd", "ddLLddddd", "LLL dddddd", "Ldd ddd ddd", "LLdddddd")),
    (("identity card", "ID card no.", "national ID", "identity number", "ID number", "Personalausweis", "Ausweisnummer", "Ausweis-Nr.", "DNI", "NIE", "NIF", "documento de identidad", "carte d'identité", "CNI n°"), ("ddddddddL", "dd.ddd.ddd-L", "Ldddddddd", "Xddddddd-L", "LddLdddddd", "dddddddddddd", "LLLddddddd", "dddddddd-L", "Yddddddd L")),
    (("member number", "member no.", "membership number", "member ID", "policy holder number", "insurance number", "Versichertennummer", "Versicherungsnummer", "Mitgliedsnummer", "Krankenversichertennummer", "número de afiliación", "número de socio", "numéro d'adhérent", "numéro d'assuré", "health card", "Medicare number", "NHS number"), ("Ldddddddddd", "LLL-dddddd", "M-dddddd", "ddd ddd dddd", "dd dddddd L ddd", "L-dddd-dddd", "dddd dddd dddd", "LLdddddddd", "dd/dddddddd/dd", "dddddddddL")),
    (("driving licence", "driver's license", "driver licence no.", "licence number", "license no.", "Führerschein", "Führerscheinnummer", "permiso de conducir", "carné de conducir", "permis de conduire"), ("Lddd-dddd-dddd", "LLLLLdddddd LL", "LddddddddL", "Ldddddddddddd", "dddddddd", "LLdddddddddL", "ddLLddddd")),
    (("tax ID", "tax number", "Steuer-ID", "Steueridentifikationsnummer", "Sozialversicherungsnummer", "Rentenversicherungsnummer", "número de la Seguridad Social", "NUSS", "numéro de sécurité sociale", "n° de sécu"), ("dd ddd ddd ddd", "ddddddddddd", "dd dddddd L ddd", "dd/dddddddddd", "n dd dd dd ddd ddd dd", "nddddddddddddd", "dd dddddddd dd")),
)
#: The same kinds of marks that name a thing, not a person.
THINGS = (
    ("serial number", "serial no.", "S/N", "device", "batch", "batch no.", "lot", "ticket", "ticket no.", "case", "incident", "order", "invoice", "account", "account number", "IBAN", "card ending", "sort code", "terminal", "asset tag", "build", "revision", "reference", "tracking number", "part no.",
     "Seriennummer", "Charge", "Gerät", "Vorgang", "Rechnung", "Konto", "Kontonummer", "Bestellung", "número de serie", "lote", "pedido", "factura", "cuenta", "incidencia", "numéro de série", "lot", "dossier", "facture", "compte", "commande", "hash", "checksum", "meter", "router"),
    ("LL-ddddd", "dddddd", "ddddddddd", "ddd-dd-dddd", "dddd-dddd", "LLdddddddd", "Ldddddddd", "LLL-dddd-LL", "dd.ddd.ddd", "GBdd LLLL dddd dddd dddd dd", "DEdd dddd dddd dddd dddd dd", "dddd dddd dddd dddd", "dd-dd-dd", "#ddddd", "ddd/dddd", "SN-dddddddd", "0xddddd", "LLLddddddd", "dd dd dd dd", "ddd ddd ddd", "20dd-dddd", "+dd.dd", "ddddddddddd"),
)


def _town(r):
    x = r.choice(TOWNS) if r.random() < 0.45 else _invented(r) if r.random() < 0.4 else r.choice(STREET_WORDS) + r.choice(TOWN_TAILS)
    return r.choice(("Saint ", "New ", "Bad ", "La ", "Port ", "San ")) + x if r.random() < 0.1 else x


def _address(r, _):
    n = str(r.randrange(1, 300)) + (r.choice("abcBC") if r.random() < 0.1 else "")
    sep = r.choice((", ", ", ", ", ", "\n", ",\n", " "))
    lang = r.choice(("en", "en", "us", "us", "box", "de", "es", "fr"))
    if lang in ("en", "us"):
        street = f"{n} {r.choice(STREET_WORDS) if r.random() < 0.6 else _invented(r)} {r.choice(STREET_KINDS)}"
        if r.random() < 0.2:
            street = f"{r.choice(('Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Room'))} {r.randrange(1, 60)}{r.choice(('', '', 'A', 'B'))}{r.choice((', ', ' '))}{street}"
        elif r.random() < 0.2:
            street += f"{r.choice((', ', ' '))}{r.choice(('Apt', 'Apt.', 'Suite', 'Unit', 'Floor', 'Flat', '#'))} {r.randrange(1, 60)}"
        code = _digits(r, r.choice(("LLn nLL", "Ldd dLL", "LLdd dLL", "Ln dLL"))) if lang == "en" else r.choice(("", "", r.choice("IL TX OR CO NY CA OH".split()) + " ")) + _digits(r, r.choice(("ddddd", "ddddd-dddd")))
        k = r.random()
        return street if k < 0.22 else f"{street}{sep}{_town(r)}" if k < 0.42 else f"{street}{sep}{_town(r)}{r.choice((', ', ' '))}{code}"
    if lang == "box":
        box = f"{r.choice(('P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box', 'Postfach', 'Apartado', 'Apartado de Correos', 'Apdo.', 'Boîte postale', 'BP', 'B.P.', 'Private Bag'))} {r.choice((str(r.randrange(1, 9999)), _digits(r, 'nd dd dd')))}"
        k = r.random()
        return box if k < 0.2 else f"{box}{sep}{_town(r)}" if k < 0.4 else f"{box}{sep}{_digits(r, 'ddddd')} {_town(r)}"
    code = _digits(r, r.choice(("ddddd", "ddddd", "dddd", "D-ddddd" if lang == "de" else "ddddd")))
    if lang == "de":
        street = f"{r.choice(DE_STREET) if r.random() < 0.6 else _invented(r)}{r.choice(('straße', 'str.', 'strasse', 'weg', 'platz', 'allee', 'gasse', 'ufer', 'ring', '-Straße', 'damm'))} {n}"
        street = r.choice((street, street, street, f"Am {r.choice(DE_STREET)}{r.choice(('berg', 'tor', 'park', 'bach'))} {n}", f"An der {_invented(r)} {n}", f"{r.choice(('Alte', 'Neue', 'Lange', 'Obere'))} {r.choice(('Straße', 'Gasse', 'Allee'))} {n}", f"Unter den {r.choice(DE_STREET)} {n}"))
    elif lang == "es":
        street = f"{r.choice(('Calle', 'C/', 'C/ ', 'Avenida', 'Av.', 'Avda.', 'Plaza', 'Paseo', 'Camino', 'Ronda', 'Travesía', 'calle')).strip()} {r.choice(ES_STREET) if r.random() < 0.6 else _invented(r)}{r.choice((' ', ', ', ' n.º ', ', nº '))}{n}{r.choice(('', '', '', ', ' + str(r.randrange(1, 9)) + r.choice(('º A', 'º B', 'º izq.', 'ª')), ', piso ' + str(r.randrange(1, 9))))}"
    else:
        street = f"{n}{r.choice((' ', ', ', ' bis '))}{r.choice(('rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai', 'allée', 'impasse', 'route', 'bd', 'Rue', 'Avenue'))} {r.choice(FR_STREET) if r.random() < 0.6 else _invented(r)}{r.choice(('', '', '', ', appt ' + str(r.randrange(1, 40)), ', bâtiment ' + r.choice('ABC')))}"
    k = r.random()
    return street if k < 0.25 else f"{street}{sep}{_town(r)}" if k < 0.35 else f"{street}{sep}{code} {_town(r)}"


def _id(r, _):
    cues, forms = r.choice(IDS)
    join = r.choice((" ", " ", ": ", " is ", " no. ", " = ", " (", " #", "\n", " lautet ", " es ", " est le ", " - ", " / "))
    # Forms differ by country and year: a third are any mix of letters and digits, or groups of digits.
    k = r.random()
    form = r.choice(forms) if k < 0.65 else "".join(r.choice("ddddL") for _ in range(r.randrange(7, 14))) + "d" if k < 0.85 else r.choice(" -./").join("d" * r.randrange(2, 5) for _ in range(r.randrange(3, 6)))
    return [(r.choice(cues) + join, None), (_digits(r, form), "id_number"), (")" if join == " (" else "", None)]


def _thing(r, _):
    cue = r.choice(THINGS[0])
    return f"{cue if r.random() < 0.7 else cue.capitalize()}{r.choice((' ', ' ', ': ', ' is ', ' no. ', ' = '))}{_digits(r, r.choice(THINGS[1]))}"


def _class(r, _):
    a, b = r.choice(WORDS).capitalize(), r.choice(WORDS).capitalize()
    return r.choice((f"{a}{b}", f"ex:{a}{b}", f"{a} {b}", f"has{a}", f"{r.choice(WORDS)}:{a}", f"{a.upper()}_{b.upper()}", f"{a} {b} {r.choice(TERMS)}", f"{a} {r.choice(TERMS)}", f"{r.choice(TERMS)} {r.choice('ABCD')}", f"{a} {r.randrange(20)}", f"{r.choice(WORDS)}.{r.choice(WORDS)}", f"rdfs:{r.choice(('label', 'comment', 'domain', 'range'))}", a, f"the {a} {b}"))


def _org(r, _):
    x = r.choice((_invented(r), r.choice(STREET_WORDS), r.choice(LAST), r.choice(TOWNS), _town(r), f"{r.choice(LAST)} & {r.choice(LAST)}", f"{r.choice(STREET_WORDS)} {r.choice(STREET_WORDS)}", f"St {r.choice(FIRST)}"))
    return r.choice((f"{x} {r.choice(ORGS)}", f"{x} {r.choice(ORGS)}", f"{r.choice(ORGS[3:8])} of {x}", f"the {r.choice(WORDS).capitalize()} {r.choice(ORGS)}", f"{r.choice(('Universität', 'Klinikum', 'Banco', 'Hospital', 'Banque', 'Mairie de', 'Stadtwerke', 'Ayuntamiento de'))} {x}"))


def _number(r, _):
    return _digits(r, r.choice(("20dd-0n-1d", "nd.0n.20dd", "n/nd/20dd", "nd:dd", "1d:dd:dd", "n,ddd.dd", "n.ddd,dd", "nd %", "n.d.d", "v2.nd", "nd ms", "nddd", "10.0.d.nd", "EUR nd.dd", "$nd", "0.dd", "20dd", "20dd-0n-1dT1d:dd:00Z", "FR-nd", "REQ-ddd", "CQn", "n of nd", "nd x nd", "nd kg", "n.ddd.ddd", "§ nd", "nd-nd", "dd/dd", "(nd)", "n)")))


def _prose(r, _):
    """A clause of general words in one language, now and then with words in capitals as headings and terms have them."""
    lang = r.choice(("en", "en", "de", "de", "es", "fr"))
    noun = lambda: r.choice(NOUNS[lang]) + (r.choice(NOUNS[lang]).lower() if lang == "de" and r.random() < 0.3 else "")
    words = []
    for _ in range(r.randrange(1, 5)):
        words += r.choices(LINKS[lang], k=r.randrange(0, 3))
        x = noun()
        words.append(x.capitalize() if r.random() < 0.2 else x)
        k = r.random()
        if k < 0.4:
            words.append(r.choice(VERBS[lang]))
        elif k < 0.5:
            words.append(_code(r, _))
        elif k < 0.56:
            words.append(_number(r, _))
        elif k < 0.6:
            words[-1] += ","
    words[0] = words[0][:1].upper() + words[0][1:]
    return " ".join(words) + r.choice((".", ".", ".", ":", "", " -", "?"))


def _coin(r, _):
    """Coined names of products, systems and places: only what stands around them tells them from people."""
    x = r.choice((_invented(r), _invented(r), _town(r), r.choice(LAST), r.choice(WORDS).capitalize() + r.choice(ENDS)))
    return f"{x} {_invented(r)}" if r.random() < 0.2 else x


def _code(r, _):
    """Marks of requirements, tickets, parts and runs that stand without a word that explains them."""
    form = r.choice(("LL-dddd", "LL-dd", "LLL-ddd", "LL-n", "LLL-dddd", "LLLL-n", "Ldddddd", "LLdddddd", "dddddd", "ddddddddd", "dd-dddd", "ddd-dd-dddd", "nddd-ddd-dddd", "ddd-dddd", "n.dd.dddd", "dd dd dd dd", "LL-dddd-LL", "#dddd", "LddLdd", "(LL-ddd)", "[LL-dd]", "LL/dddd/dd"))
    k = r.random()
    form = "".join(r.choice("ddL") for _ in range(r.randrange(5, 12))) if k < 0.25 else r.choice(" -./").join(r.choice(("dd", "ddd", "dddd", "LL", "d")) for _ in range(r.randrange(2, 6))) if k < 0.45 else form
    x = _digits(r, form)
    return x.lower() if r.random() < 0.15 else x


def _month(r, _):
    return f"{r.randrange(1, 29)}{r.choice((' ', '. ', ' de ', ' '))}{r.choice('January March April May June July August October December Januar März Mai Oktober enero abril agosto mayo janvier avril août'.split())}"


SLOTS = {
    "name": lambda r, g: [(_name(r, g), "name")], "full": lambda r, g: [(_full(r, g), "name")], "first": lambda r, g: [(_alone(r, g), "name")], "mail": lambda r, g: [(_email(r, g), "email")],
    "phone": lambda r, g: [(_digits(r, r.choice(PHONES)), "phone")], "address": lambda r, g: [(_address(r, g), "address")], "id": _id,
    "titled": lambda r, g: [(r.choice(TITLES), None), (r.choice((_last(r), _full(r, g), _name(r, g))), "name")],
    "n": lambda r, g: [(str(r.randrange(1, 10 ** r.randrange(1, 4))), None)], "did": lambda r, g: [(r.choice(DID[r.choice(("en", "en", "en", "de", "es", "fr"))]), None)], "coin": lambda r, g: [(_coin(r, g), None)], "prose": lambda r, g: [(_prose(r, g), None)], "code": lambda r, g: [(_code(r, g), None)], "thing": lambda r, g: [(_thing(r, g), None)], "class": lambda r, g: [(_class(r, g), None)], "org": lambda r, g: [(_org(r, g), None)], "number": lambda r, g: [(_number(r, g), None)], "month": lambda r, g: [(_month(r, g), None)],
    "word": lambda r, g: [(r.choice(WORDS), None)], "Word": lambda r, g: [(r.choice(WORDS).capitalize(), None)], "role": lambda r, g: [(r.choice(ROLES), None)], "town": lambda r, g: [(_town(r), None)],
}

#: Patterns by family, with ``|`` between patterns; ``¦`` stands for a bar in the text.
FAMILIES = {
    "call_en": "Call {full} on {phone}.|Ring {phone} after office hours.|Our hotline is {phone}, ask for {first}.|{full} can be reached at {phone} or {mail}.|Phone: {phone}|Tel.: {phone}, fax: {phone}|mobile {phone}|Reach the {role} under {phone} before {number}.|Please dial {phone} and quote {thing}.|My new number is {phone}.|"
    "Contact {mail} or {phone}.|If the {word} fails, phone {first} ({phone}).|text me at {phone} please|The caller left {phone} as call-back number.|Support desk {phone} (weekdays)|my number is {phone}|{full} {phone}|{phone} {did}|{prose} {phone} {prose}|the {word} rang at {phone}|phone {phone} was entered in the wrong {word}",
    "write_en": "Send the {word} to {mail}.|Write to {mail} for access.|E-mail: {mail}|Please forward this to {mail} and copy {mail}.|The address {mail} bounced twice.|Questions? {mail}|Mail from <{mail}> was delayed.|See mailto:{mail} for details.|{full} <{mail}> wrote:|{titled} is at {mail} now.|Find {full} at {mail} or at {address}.|ask {first} at <{mail}>|cc {mail}; {mail}|reply to {mail}|{mail} asked for a new {word}.|The account belongs to {mail}, not to the {role}.|invitations go out via {mail}",
    "lives_en": "{full} lives at {address}.|{full} lives at {address}\n{Word}.|the {word} went to {address}\n{Word} {word}|{address}\n{Word}|Deliver the {word} to {address}.|The office moved to {address} in {month}.|Home address: {address}|Send it by post to {address}.|He was visited at {address} by the {role}.|Postal address: {address}|Billing address\n{address}\n|The letter to {address} came back.|Ship to {full}, {address}.|resident at {address} since {number}|a parcel for {address} was lost|We met at {address}, near the station.",
    "number_en": "His {id} was copied by mistake.|The {id} belongs to {full}.|She gave her {id} at the desk.|{id}|Please remove {id} from the {word}.|The form shows {id}, which is personal.|{full}, {id}, signed the form.|Applicant: {full}; {id}|verify {id} before the {word} is opened|record holds {id} in clear text|born {number}, {id}",
    "people_en": "{full} approved the change.|{titled} will sign on {month}.|We asked {full} and {full} to review it.|Reviewed by {name} on {number}.|Thanks, {first}|Hi {first},\n|Dear {titled},\n|Kind regards\n{full}\n{role}, {org}|{full} and {first} disagreed.|According to {titled}, the {word} is fine.|Author: {name}|Owner: {name}|Present: {full}, {full}, {name}|Apologies: {name}; {name}|The patient {full} was seen by {titled}.|{first} said the {word} was late.|{first}, {first} and {first} were there.|the handover from {name} to {name} is done|ask {first} via {phone}|Action: {first} to update the {word} by {month}.|Customer {full} complained about {class}.|signed {name}|as {name} pointed out, {class} is missing|Attendees\n- {full}\n- {full}\n- {name}|{full} ({role}) joined at {number}|the {word} of {full} is {word}|The {word} for {name} is {word}.|the {word} by {full} {did}|Thanks, {full} {Word} {word}: {n}|Regards {full} {Word} {word} {phone}|{prose} {full} {Word} {word} {phone}|{prose} {full} {Word} {word} ({n})|{prose} {full} {prose}|{full}, the new {role}, {did}|a letter from {full} came in {month}|{full} is our {role}.|{first}'s {word} {did}|it was {full} who {did}|the talk by {full} was {word}|{prose} {titled} {did}|we should ask {full} whether {class} holds|Minutes taken by {name}.|{titled} and {titled} were absent.|the {role}, {full}, agreed|Assigned to {name}; due {number}|Interviewer: {titled}|witness {full} stated that the {word} was open",
    "doing": "{full} {did} in {month}.|{first} {did}.|{first} {did} {number} {word}.|{full} {did} the {word}.|{titled} {did} {prose}|{first} and {first} {did}.|{name} {did} {org}.|yesterday {full} {did}|{prose} {full} {did}.|As {first} {did}, {prose}|{first}, who {did}, {did} again.|{word} for {full}: {prose}|{word} by {full}: {prose}|{full}, {role}, {did}.|{word}: {full}; {word}: {first}|{first} {did} and {first} {did}|we met {full} at {number}|my {word} {full} {did}",
    "ids": "{id}|{id}.|{id}, {word}|{full}: {id}|{id} {did}|{prose} {id} {prose}|{word} {id} ({month})|the {id} is {word}|{id} issued in {coin}.|{id}, issued in {coin}. {prose}|{id} from {coin}.|{id} valid in {town}, {prose}|{id}, ausgestellt in {coin}.|{id} expedido en {coin}.|{id} délivré en {coin}. {prose}|{id} expired|{id} is void|copy of the {id}|{prose} {id}.|{full} has {id}|{id} on the {word}|The {word} of {full} ({id}) is {word}.|the {word} for {name}, {id}, is {word}|{word} by {full} with {id}|the {word} of {titled}, {id}|{id} ist {word}|{id} es {word}|{id} est {word}|her {id} {did}|old {id}, new {id}|{id}\n{word}",
    "german": "{full} wohnt in der {address}.|Bitte rufen Sie {titled} unter {phone} an.|Telefon: {phone}|Rückfragen an {mail}.|Ansprechpartner ist {full}, Tel. {phone}.|Die Anschrift lautet {address}.|Senden Sie die Unterlagen an {address}.|Mit freundlichen Grüßen\n{full}|Sehr geehrte {titled},\n|Sehr geehrter {titled},\n|Die {id} steht im Antrag von {full}.|Er legte den {id} vor.|Ihre {id} wurde gespeichert.|{full} hat die Prüfung bestätigt.|{full} übernimmt ab {month}.|{id} wurde kopiert.|{id} gültig bis {number}|Teilnehmer: {full}, {name}, {full}|Laut {titled} ist {class} falsch.|Protokoll: {name}|E-Mail an {mail} gesendet.|Handy {phone}|{first} meldet sich am {month}.|Die Kundin {full} rief um {number} an.|Geprüft von {name}|unter {phone} ist niemand erreichbar",
    "spanish": "{full} vive en {address}.|Llame a {titled} al {phone}.|Teléfono: {phone}|Escriba a {mail} para más datos.|El domicilio es {address}.|Envíe los papeles a {address}.|Un saludo,\n{full}|Estimado {titled}:\n|Estimada {titled}:\n|El {id} figura en la solicitud de {full}.|Presentó su {id} en la ventanilla.|{full} aprobó el cambio.|{full} firmó.|{id} verificado.|{id} caducado en {number}|Asistentes: {full}, {full} y {name}|Según {titled}, {class} es incorrecto.|Acta redactada por {name}.|Correo: {mail}|móvil {phone}|{first} llamará el {month}.|La clienta {full} se quejó.|Revisado por {name}|con {id} y domicilio en {address}|puede contactar con {full} en {mail}",
    "french": "{full} habite au {address}.|Appelez {titled} au {phone}.|Téléphone : {phone}|Écrivez à {mail} pour en savoir plus.|L'adresse est {address}.|Envoyez le dossier au {address}.|Cordialement,\n{full}|Cher {titled},\n|Chère {titled},\n|Le {id} figure sur la demande de {full}.|Elle a présenté son {id} au guichet.|{full} a validé la demande.|{full} et {full} sont en congé.|{id} a été copié.|{id} valable jusqu'en {number}|Présents : {full}, {full} et {name}|Selon {titled}, {class} est faux.|Compte rendu de {name}.|Courriel : {mail}|portable {phone}|{first} rappellera le {month}.|La cliente {full} a écrit.|Relu par {name}|joindre {full} au {phone} ou par {mail}",
    "loose": "{word} {phone} {word}|{Word} {mail} {word}|{word} {address} {word} {word}|{word} {full} {word}|{phone}|{mail}|{address}|{full}|{id} {word}|{word} {word}: {address}|{word} {word}: {phone}|{word} {word}: {mail}|{word}: {full}|{word} ({phone})|{word} ({mail})|{word} ({full})|{word}, {address}, {word}|{number} {full} {number}|{thing}, {phone}|{class} {full} {class}|{class} {mail} {class}|{number} {address}; {word}|{word} \"{mail}\" {word}|{org}, {address}|{org}: {full}, {phone}|{word} / {phone} / {mail}|{name} ¦ {word} ¦ {number}|{titled} {word} {word}|{word} {id}, {word}",
    "headers": "From: {full} <{mail}>\nTo: {mail}\nSubject: {word} {word}\n|From: {mail}\nDate: {number}\n|To: {name}; {name}\n|Von: {full} <{mail}>\nBetreff: {Word}\n|De: {full} <{mail}>\nAsunto: {word}\n|De : {full}\nObjet : {word}\n|Cc: {full}, {full}\n|Contact\nName: {name}\nPhone: {phone}\nMail: {mail}\nAddress: {address}\n|{full}\n{role}\n{phone}\n{mail}\n|{full}\n{address}\n|--\n{full}\n{org}\n{address}\nT {phone}\n|name ¦ {name}\nphone ¦ {phone}\naddress ¦ {address}\n{id}\n|{full}; {phone}; {mail}; {address}|{name}\t{mail}\t{phone}|Name: {name}, {id}, tel {phone}",
    "plain_prose": "{prose}|{prose} {prose}|{prose} {prose} {prose}|{code}: {prose}|{prose} {code}|- {prose}\n- {prose}\n|{Word}: {prose}|{number} {prose}|{prose} ({code}, {code})|{code} and {code}|see {code}, {code} and {code}|{class}: {prose}|{prose} {thing}.|{code} {prose} {number}|{Word} {number}\n{prose}\n|{word}@{word}|{n}@{word}{n}|{word}{n}@{word}{n}|root@{word}-{word}|{Word}{Word}@{word}|{word} at {word}|{prose} at {town}.|{number} at {number}|{word} at {number} on {month}|¦ {code} ¦ {prose} ¦ {number} ¦\n|\"{prose}\"|{prose} {org}, {code}|{prose} {class} {class} {prose}",
    "plain_coined": "{coin} is down since {number}.|the {word} of {coin} is open|between {coin} and {coin}|in {coin}, {coin} and {town}|for {coin}, the {word} changes|with {coin} or {coin}|{prose} in {coin}, {prose}|{prose} for {coin} is {word}.|{Word} of {coin}|the {Word} of {coin} approved it|The {org} decides on {code}.|by the {org} on {month}|the {coin} {word}|The {coin} {Word} starts at {number}|{coin} and {coin} are {word} names|from {coin} to {coin}|{coin}, {coin}, {coin}: {prose}|{coin} {code} is a {word}|{Word} {code} is a {word}|{word} {code}, {word} {code}|upgrade {coin} to {number}, then {coin}|{prose} von {coin} und {coin}.|die {Word} {coin} ist {word}|el {word} de {coin} y {coin} es {word}|le {word} de {coin}, {coin} et {coin}|in {coin} and {coin}, {prose}|As of {month}, {coin} is the default.|under {coin} law|{coin} supports {class} and {coin}|the product {coin} by {org}|{thing} is {word}|{code} is not a {word}"
    # Lists of coined names, and coined names that begin a sentence.
    "|in {town}, {coin}, {coin} and {coin}|for {coin}, {coin}, {coin}, {prose}|{prose} for {coin}, {coin}, {word}.|{coin}, {coin}, {coin} and {coin} {prose}|für {coin}, {coin} und {coin}|{prose} für {coin}, {coin}, {coin}.|en {coin}, {coin}, {coin} y {coin}|dans {coin}, {coin}, {coin} et {coin}"
    "|{prose} {coin} in the {word} is {word}.|{prose} {coin} of the {word} {prose}|{prose} {coin} {word} {prose}|{coin} {word} {word} {prose}|{coin} on the {word} of {coin}|{prose} {coin} at {number}.|{coin} im {Word} {prose}|{coin} en la {word} {prose}|{coin} dans le {word} {prose}|{prose} {coin} for {month} {prose}|{word} {word} for {coin}, {coin}, {word} {word}|The {word} {word} in {coin}, {coin}, {word} and {word}.|{Word} {word} of {coin}, {coin}, {word}",
    "plain_en": "The {word} shall be stored within {number}.|If the {word} is empty, the {role} sees an error.|{class} is a subclass of {class}.|The {role} opens the {word} and checks {thing}.|{org} approved the {word}.|{Word} {number}: the {class} must have a {word}.|See {thing}.|{thing} was replaced in {month}.|The {org} meets on {month}.|Section {number} defines {class}.|Each {class} has exactly one {class}.|The system logs {thing} and {thing}.|{class}|{Word} {word} {word}.|Deployed build {number} to {town}.|The branch in {town} closes at {number}.|Error {number} in {class} after {number}.|@prefix ex: <http://example.org/{word}#> .|ex:{Word} a owl:Class ; rdfs:label \"{Word}\" .|see http://example.org/{word}/{Word}#{word}|@{word} is a decorator|user@{word} is no mailbox|The {org} and the {org} share a {word}.|Note: {class} and {class} overlap.|On {month} the {word} failed {number} times.|- {word}\n- {word}\n- {Word} {word}\n|1. {Word}\n2. {Word}\n|Glossary: {Word} means a {word} of a {word}.|{Word}: a {word} kept by the {org}.|¦ {word} ¦ {number} ¦\n¦ {word} ¦ {number} ¦\n|for i in range({number}): {word}()|{number} rows, {number} errors, {number} warnings|Ticket opened at {number} by the {role}.|Good morning,\n|Thanks and best regards\n|Hello all,\n|To whom it may concern|Release {number} of {Word} {Word} is out.|Monday to Friday, {number} to {number}|The {Word} {Word} of {town} was tested in {month}.|Summary\n|Open Questions\n|Acceptance Criteria\n|The Customer shall confirm the Order.|The Bank returns the Card to the Customer.|{class} to {class} is allowed at {number}|In {month} we visit {town} and {town}.|The trains from {town} to {town} were late.|{class} and {class}|{class}: {class}, {class}|Please restart {class} in {class}.|Room {number}, second floor|room {number} on floor {number}|port {number}, line {number}, page {number}",
    "plain_other": "Das System speichert {thing} für {number} Tage.|Der {Word} muss innerhalb von {number} antworten.|{class} ist eine Unterklasse von {class}.|Die {org} hat {thing} freigegeben.|Siehe Abschnitt {number}.|Die Sitzung am {month} dauerte {number}.|Guten Tag,\n|Zusammenfassung\n|Die Filiale in {town} öffnet um {number}.|Der Kunde bestätigt die Bestellung.|El sistema guarda {thing} durante {number} días.|{class} es una subclase de {class}.|El {org} aprobó {thing}.|La Comisión de {Word} y el Comité de {Word} aprobaron el plan.|El paquete salió de {town} hacia {town}.|Le Conseil de {Word} a voté.|Le train de {town} à {town}.|Der Zug von {town} nach {town}.|Der Ausschuss für {Word} tagt in {town}.|Véase la sección {number}.|La reunión del {month} duró {number}.|Buenos días:\n|Resumen\n|La sucursal de {town} abre a las {number}.|El Cliente confirma el Pedido.|Le système conserve {thing} pendant {number} jours.|{class} est une sous-classe de {class}.|La {org} a approuvé {thing}.|Voir la section {number}.|La réunion du {month} a duré {number}.|Bonjour,\n|Résumé\n|L'agence de {town} ouvre à {number}.|Le Client confirme la Commande.|Mit {class} und {class} gibt es {number} Fehler.|Il y a {number} erreurs dans {class}.|Hay {number} errores en {class}.|Offene Punkte\n- {Word} {word}\n|Puntos abiertos\n- {Word} {word}\n|Points ouverts\n- {Word} {word}\n",
}
_SLOT = re.compile(r"\{(\w+)\}")


def patterns(family: str) -> list[str]:
    return [p.replace("¦", "|") for p in FAMILIES[family].split("|") if p]


def filled(pattern: str, r: random.Random, given: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, at = "", [], 0
    for m in _SLOT.finditer(pattern):
        out += pattern[at : m.start()]
        for text, kind in SLOTS[m.group(1)](r, given):
            if kind:
                spans.append((len(out), len(out) + len(text), kind))
            out += text
        at = m.end()
    return out + pattern[at:], spans


def labelled(given: list[str], seed: int = 5, rows: int = 8_000, families: tuple[str, ...] = tuple(FAMILIES), empty: float = 0.0) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Up to ``rows`` texts of one to four filled patterns each, from the named families."""
    r = random.Random(seed)
    out = []
    pool = [p for f in families for p in patterns(f)]
    plain = [p for f in families if f.startswith("plain") for p in patterns(f)]
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.choice((1, 1, 2, 3, 4))):
            # Most of what is read holds nothing personal.
            t, s = filled(r.choice(plain if plain and r.random() < empty else pool), r, given)
            if text and not text.endswith("\n"):
                text += r.choice((" ", " ", " ", "\n", "\n\n", "  ", "\n- ", "; "))
            spans += [(a + len(text), b + len(text), k) for a, b, k in s]
            text += t
        out.append((text, spans))
    return out
