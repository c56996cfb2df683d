"""Sentences written by hand, apart from the patterns of the labelled table: a fixed test set.

A finding stands in double brackets after its kind: e mail, p phone, i identity number, a address, n name.
"""

import re

KIND = {"e": "email", "p": "phone", "i": "id_number", "a": "address", "n": "name"}

TEXT = """
Yesterday [[n:Bartholomew Quigley]] resigned as treasurer.
If nothing helps, get hold of [[n:Tamsin]] via [[p:+44 20 7946 0958]].
Our guest [[n:Octavia Bligh]] spoke about storage.
The visitor was [[n:Henrietta Vance]], wife of the colonel.
My landline is [[p:(415) 555-0132]] and I am home after six.
You can drop a line to [[e:hugo.brandt@lighthouse.example]] any time.
Mrs. [[n:Pemberton]] lost her glasses in the lobby.
He moved to [[a:7 Church Walk, Harrogate HG1 4RT]] last spring.
The courier went to [[a:1600 Pennsylvania Avenue, Washington, DC 20500]] by mistake.
They sent two copies to [[a:P.O. Box 1182, Topeka, KS 66601]].
Her passport [[i:L8988901C]] expired.
Passenger passport: [[i:L8988901C]], issued in Utopia.
National insurance [[i:QQ 12 34 56 C]] was printed on the payslip.
The clerk wrote SSN [[i:078-05-1120]] on the envelope.
Social security: [[i:219-09-9999]].
Driving licence [[i:MORGA657054SM9IJ]] was scanned.
Steuer-ID [[i:65 929 970 489]] liegt dem Amt vor.
Mi DNI es [[i:12345678Z]] y no lo encuentro.
NIE [[i:X1234567L]] caducado.
Numéro de sécurité sociale : [[i:2 69 05 49 588 157 80]].
The health insurer knows her as member [[i:A123456780]].
Old card, member number [[i:HM-4471902]], is void.
Kontakt: [[n:Anneliese Vogt]], [[a:Rosenheimer Straße 14, 81669 München]].
Herr [[n:Blumenthal]] ist erkrankt, Vertretung durch [[n:Gesine Ahrens]].
Sie erreichen uns unter [[p:+49 89 1234567]].
Meine neue Nummer: [[p:0171 2345678]]
Bitte an [[e:service@stadtwerke.example]] schreiben.
[[n:Björn Hägglund]] übernimmt ab Montag.
La señora [[n:Echeverría]] llegó tarde.
Pregunte por [[n:Lourdes]] en recepción o llame al [[p:+34 91 123 45 67]].
Vivo en [[a:Calle de Alcalá 45, 28014 Madrid]].
Su correo es [[e:lourdes_m@correo.example]].
[[n:Iker Zubizarreta]] firmó el acta.
Madame [[n:Beauchamp]] a pris rendez-vous.
Notre numéro : [[p:01 44 55 66 77]].
Il habite [[a:12 rue de Rivoli, 75004 Paris]].
Écrire à [[e:accueil@mairie.example]] avant lundi.
[[n:Gaëlle Kerjean]] et [[n:Loïc Tanguy]] sont absents.
Speakers included [[n:Ahmed Hassan]], [[n:Priya Natarajan]] and [[n:Wei Zhang]].
[[n:Oluwaseun Adebayo]] found the leak in the parser.
I had lunch with [[n:Siobhán]] and she agreed.
The handover from [[n:Kowalczyk]] to [[n:Jensen]] took an hour.
Minutes: [[n:T. Featherstone]]
Chair: [[n:Featherstone, Tobias]]
[[n:R. J. Blackwood]] seconded the motion.
signed off by [[n:Yevgenia Markova]] at noon
As [[n:Ingrid]] said, nothing changed.
Best,
[[n:Cedric Oyelaran]]
Sincerely yours,
[[n:Wilhelmina de Groot]]
Regards, [[n:Anand]]
Hello [[n:Beatriz]], could you look into it?
Dear Ms. [[n:Tchaikovsky]],
Dear Professor [[n:Okonkwo-Bright]],
Thank you, [[n:Rosalind]].
Professor [[n:Lindgren]] will present the results.
The tenant, [[n:Marguerite Delacroix]], paid in cash.
Emergency contact: [[n:Paul Whitcombe]], [[p:020 7946 0011]].
Next of kin [[n:Saoirse Kinsella]] ([[p:+353 1 496 0000]])
Bug reported by [[n:Zhanna]]; fix by [[n:Thorvald]].
[[n:Akira Fujimoto]] (platform team) will follow up.
Spoke to [[n:Nkechi Eze]] on the phone.
Invite [[n:Delphine]], [[n:Marcus]] and [[n:Yolanda]].
Account holder [[n:Jonathan P. Archer]] disputes the fee.
[[n:LEONARD COHN]] is printed on the badge.
Cardholder name: [[n:Stavros Papadakis]]
Beneficiary [[n:Mei-Ling Chow]] was verified.
Lead: [[n:Kofi]]; deputy: [[n:Ama Owusu]]
The report by [[n:Sanchez-Villalobos]] is overdue.
[[n:Dimitra]] asked why the test fails.
According to [[n:Heinz-Peter Kruse]] the index is stale.
We thank [[n:Francesca Moretti]] for the photos.
Reach me on [[p:+1 212 555 0187]].
WhatsApp [[p:+55 11 91234-5678]] works as well.
switchboard [[p:0131 496 0777]]
Toll-free: [[p:1-800-555-0199]]
His cell, [[p:303.555.0144]], is off.
after hours dial [[p:(0161) 496 0345]] and wait
Tel [[p:+41 44 668 18 00]]
Fax [[p:+43 1 58858 0]] is no longer used.
Rückruf erbeten: [[p:030/901820]]
tél. [[p:+33 1 70 18 99 00]]
móvil: [[p:612 345 678]]
Please ring the surgery on [[p:01632 960 983]].
number to call: [[p:+91 98765 43210]]
The hotline ([[p:+61 2 5550 1234]]) is free.
SMS to [[p:+972 50 123 4567]] was rejected.
Use [[e:jane.doe@example.org]] for billing.
Old address [[e:J.Doe99@EXAMPLE.ORG]] is dead.
[[e:first.last+tag@sub.domain.example]] is valid.
Try [[e:webmaster (at) garden (dot) example]] instead.
contact [[e:sales [at] widgets [dot] test]] for a quote
spell it [[e:mike at workshop dot example]] in slides
It bounced for <[[e:noreply@alerts.invalid]]>.
mailto:[[e:press@museum.example]]
Both [[e:a.b@c.example]] and [[e:x_y@z.test]] got it.
Write [[e:ops-team@cluster7.test]]; they answer fast.
sender=[[e:cron@node-12.test]]
"[[e:quotes@saying.example]]" was in the header
Kopie an [[e:buchhaltung@firma.example]]
copia a [[e:gerencia@tienda.example]] por favor
Enviar a [[e:ventas arroba tienda punto example]]
My flat: [[a:Flat 3, 22 Acacia Avenue, Reading RG1 2AB]].
They live at [[a:221B Baker Street, London]].
Visit us: [[a:350 Fifth Avenue, Suite 4100, New York, NY 10118]]
Deliver to [[a:18 Rue des Fleurs, 31000 Toulouse]].
Lieferadresse: [[a:Am Markt 3, 28195 Bremen]]
Wohnhaft [[a:Kastanienallee 82, 10435 Berlin]]
domicilio: [[a:Avenida de América 12, 2º B, 28028 Madrid]]
Adresse : [[a:5 place Bellecour, 69002 Lyon]]
The shop at [[a:44 Long Lane]] closed.
I grew up on [[a:9 Elmwood Drive, Akron, OH 44302]].
our registered office is [[a:1 Harbour Square, Bristol, BS1 5TY]]
Send the kit to [[a:Unit 6, 100 Industrial Way, Dayton OH 45402]].
write to [[a:PO Box 77, Dunedin 9054]]
Postfach: [[a:Postfach 1234, 50667 Köln]]
[[a:4500 Sunset Boulevard, Los Angeles, CA 90027]] is the venue.
Meet at [[a:10 Downing Street]] at nine.
Parcel for [[n:Edith Crane]], [[a:63 Willow Crescent, Bath BA2 3QJ]].
[[n:Moritz Haller]], [[a:Seestraße 21, 8002 Zürich]], Tel. [[p:+41 44 201 10 10]]
id: [[i:AB123456C]] (national insurance)
Permis de conduire n° [[i:12AB34567]]
Führerschein [[i:B072RRE2I55]] wurde kopiert.
Pasaporte [[i:AAB123456]] verificado.
Carte d'identité [[i:880692310285]]
Ausweis [[i:T22000129]] gültig bis 2031.
Medicare [[i:2123 45670 1]] on file
NHS number [[i:943 476 5919]] was faxed.
tax number [[i:12/345/67890]] appears twice
Her identity card, no. [[i:C01X00T47]], is missing.
Versichertennummer [[i:M987654321]]
patient [[n:Ottoline Marsh]], NHS [[i:485 777 3456]]
The scheduler retries three times before it gives up.
Shipping costs 14.50 EUR per parcel.
Build 20240117.3 passed on all platforms.
Serial 4471-9920-AB was flashed again.
Invoice 2023-004512 is unpaid.
Ticket INC0012345 was closed.
Batch L20391 failed inspection.
IBAN DE89 3704 0044 0532 0130 00 is used for tests.
Order 555-01-2345 has shipped.
Call the function parse_header twice.
The Steering Committee meets in Geneva.
Saint Luke Hospital ordered new scanners.
Northern Credit Union merged with Alder Bank.
See Annex B for the Account Holder class.
An Order contains at least one Line Item.
The Payment Gateway rejects expired cards.
Kubernetes restarts the pod after 30 seconds.
Version 2.14.0 fixes CVE-2021-44228.
From Monday on the office opens at 8:30.
In April we visit Hamburg and Lisbon.
Der Ausschuss tagt im Rathaus.
Die Rechnung 4711 wurde bezahlt.
La Comisión de Calidad aprobó el plan.
El lote 8842 salió de Valencia.
Le Conseil municipal a voté le budget.
Le numéro de série 99-8812 est illisible.
@Override is an annotation.
@prefix foaf: <http://xmlns.example/foaf/> .
ex:Invoice rdfs:subClassOf ex:Document .
git clone git://repo.example/tools
Chapter 12 deals with Change Requests.
The Ward Manager role has two permissions.
Order Management and Stock Control share a database.
Room 204, second floor, next to the lift.
Please restart Printer 7 in Lab 3.
Thanks a lot and good luck!
Meeting room Everest is booked.
The quick brown fox jumps over 13 lazy dogs.
Temperature 36.6, pulse 72, pressure 120/80.
Line 45: expected 3 columns, got 4.
Total: 1,234,567 rows in 00:03:12.
Best regards from the whole team
Kind regards
Mit freundlichen Grüßen
Service Level Agreement
Data Protection Officer
The Federal Reserve raised rates.
Our plumber [[n:Gunther Pfaff]] comes on Friday.
[[n:Xiomara]] has the keys, her phone is [[p:+52 55 1234 5678]].
Could [[n:Ravindra]] and [[n:Tuuli]] swap shifts?
Landlord: [[n:Ignatius Crowe]]
the neighbour at [[a:31 Orchard Terrace, Durham DH1 3QS]] complained
An: [[e:kundendienst@werkstatt.example]]
Das Paket an [[n:Roswitha Engel]], [[a:Lange Reihe 9, 20099 Hamburg]], kam zurück.
[[n:Adrián Quiroga]] vive en [[a:Plaza Mayor 3, 37002 Salamanca]].
Joindre [[n:Solène Abgrall]] au [[p:06 12 34 56 78]].
DNI [[i:98.765.432-K]]
The dean, [[n:Philippa Stonehouse]], opened the hall.
[[n:Ekene]] left early.
call [[p:0044 117 496 0123]] for the gate code
fax it to [[p:(503) 555-0170]]
reply-to: [[e:board.office@choir.example]]
Membership number [[i:8830-2217-06]] lapsed.
The parser accepts 2024-02-29 as a date.
Compile with -O2 and link libm.
Policy 17 replaces policy 12.
Warehouse 4 is full, use Warehouse 5.
Cash on Delivery is not offered.
El informe tiene 12 páginas.
Die Messung ergab 4,7 Prozent.
La salle 12 est fermée.
Please confirm by Thursday at 17:00.
"""


def sentences():
    """(text, [(start, end, kind)]) of each line."""
    out = []
    for line in TEXT.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[\[([epian]):(.*?)\]\](?!\])", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m.group(2)), KIND[m.group(1)]))
            text += m.group(2)
            at = m.end()
        out.append((text + line[at:], spans))
    return out
