"""Wording from which defective responses are made for training: parts that combine freely, in several languages.

{t} stands for a table, {c} and {d} for columns, {v} for a value and {n} for a number.
"""

from __future__ import annotations

#: openings, cores and reasons of refusals, by language
REFUSALS = [
    (
        ["", "Pardon, ", "Toutes mes excuses : ", "Hélas, ", "Navré mais ", "Bonjour, ", "Après examen, ", "Excusez-moi, "],
        ["je ne peux pas fournir de requête", "il m'est interdit de traiter cela", "je refuse d'écrire cette commande", "je n'ai pas le droit d'y donner suite", "cela dépasse ce que je sais faire", "la question restera sans réponse", "impossible de donner un résultat", "je dois renoncer à vous aider", "la demande est rejetée", "aucun code ne sera produit", "je suis incapable de répondre", "je ne souhaite pas continuer", "on ne peut malheureusement rien proposer", "je regrette de ne pouvoir vous aider", "je m'abstiens de toute réponse", "cette opération n'est pas autorisée", "je ne saurais répondre", "mieux vaut ne rien écrire", "il n'est pas envisageable d'y répondre", "je suis contraint de refuser", "vous n'obtiendrez pas de code", "je n'écrirai pas cela", "ma réponse est non", "ce n'est pas possible", "je ne dispose pas d'éléments suffisants", "les éléments fournis sont insuffisants", "rien ne peut être exécuté"],
        ["", " parce que {t} contient des données privées", " faute d'informations sur {v}", ", veuillez préciser {v}", " : la consigne est ambiguë", " tant que {t} n'est pas décrite", " pour des raisons de confidentialité", " avec si peu de contexte", " (voir {v})", ", reformulez votre question", ", merci de donner plus de détails sur {v}", " puisque {t} est protégée", " car {v} paraît confidentiel", " au sujet de {v}"],
    ),
    (
        ["", "Sorry, ", "My apologies, ", "Unfortunately, ", "Thanks for asking, but ", "As an assistant, ", "I'm afraid "],
        ["I can't provide that", "I am not able to do this", "I must refuse", "it is not possible to answer", "I won't write such a command", "there is no way to tell", "I have to decline", "this is outside what I can do", "we are unable to comply", "I do not have permission to answer", "no answer is available", "I'd rather not respond", "that would not be appropriate", "access is denied", "I'd prefer not to", "I don't think I can do it", "this can't be done", "nothing can be written here", "I regret to say no", "we can't go any further", "unable to proceed", "that is not something I can offer"],
        ["", " because {t} holds personal data", " without knowing {v}", "; please clarify {v}", " since the question is unclear", " as {t} is confidential", " for policy reasons", " given so little context", " (ticket {v})", ", please rephrase your question", "; tell me more about {v}", " as {v} seems private", " about {v}"],
    ),
    (["", "Disculpe, ", "Por desgracia, ", "Lamentablemente "], ["no puedo ayudar con eso", "me resulta imposible contestar", "no tengo permiso para escribirlo", "me niego a generar ese código", "la solicitud queda denegada"], ["", " porque {t} es privada", " sin más datos sobre {v}", "; aclare {v}"]),
    (["", "Es tut mir leid, ", "Bedauerlicherweise ", "Verzeihung, "], ["das kann ich nicht beantworten", "ich darf dazu nichts schreiben", "diese Bitte muss ich ablehnen", "eine Antwort ist nicht möglich", "dabei kann ich nicht helfen"], ["", ", weil {t} vertraulich ist", " ohne Angaben zu {v}", "; bitte {v} erläutern"]),
    (["", "Spiacente, ", "Purtroppo ", "Mi scuso, "], ["non posso aiutarti", "non mi è permesso rispondere", "devo rifiutare la richiesta", "è impossibile scrivere il codice"], ["", " perché {t} è riservata", " senza sapere {v}", "; chiarire {v}"]),
    (["", "Desculpe, ", "Infelizmente "], ["não posso ajudar com isso", "não tenho permissão para responder", "recuso escrever essa consulta", "não é possível dar uma resposta"], ["", " porque {t} é sigilosa", " sem saber {v}", "; esclareça {v}"]),
]

#: what to do with a table, told in words: beginnings, conditions and ends, by language
PROSE = [
    (["Parcourir {t}", "On ouvre d'abord {t}", "La réponse se trouve dans {t}", "Commencer par filtrer {t}", "À partir de {t}"], [" en retenant {c} = {v}", " pour chaque {c} valant {v}", ", écarter ceux où {c} passe {n}", " selon {c} et {v}", ""], [" avant de compter {d}.", " et relever {d}.", ", enfin trier par {d} jusqu'à {n}.", " ; le total de {d} donne {n}."]),
    (["Go through {t}", "To answer, scan {t}", "The result comes from {t}", "Start with {t}", "Look inside {t}"], [" for entries with {c} of {v}", ", dropping anything whose {c} exceeds {n}", " where each {c} matches {v}", " by {c}", ""], [" and list {d}.", " and count {d} over {n}.", " before sorting on {d}.", "; the sum of {d} is what you need."]),
    (["Recorrer {t}", "Primero se abre {t}", "Basta con mirar {t}"], [" buscando {c} igual a {v}", " sin los que superan {n} en {c}", ""], [" y contar {d}.", " y ordenar según {d}.", "; sumar {d} hasta {n}."]),
    (["Zuerst {t} durchsuchen", "In {t} nachsehen", "Die Tabelle {t} öffnen"], [" nach {c} mit Wert {v}", ", dabei {c} über {n} weglassen", ""], [" und {d} zählen.", " und nach {d} sortieren.", "; die Summe von {d} ergibt {n}."]),
    (["Scorrere {t}", "Basta aprire {t}", "Partire da {t}"], [" cercando {c} uguale a {v}", " senza {c} sopra {n}", ""], [" e contare {d}.", " e ordinare per {d}.", "; sommare {d} fino a {n}."]),
    (["Percorrer {t}", "Abra {t}", "Procure em {t}"], [" com {c} igual a {v}", " sem {c} acima de {n}", ""], [" e conte {d}.", " e ordene por {d}.", "; some {d} até {n}."]),
]

#: the same in other formal languages
FORMAL = [
    "{t}.query('{c} > {n}')['{d}'].sum()", "{t}.loc[{t}.{c} == '{v}', '{d}'].nunique()", "filter({t}, {c} == \"{v}\") %>% summarise(total = n())", "{t}[{c} < {n}, .({d})]",
    "db.{t}.aggregate([{{$match: {{{c}: \"{v}\"}}}}, {{$group: {{_id: \"${d}\"}}}}])", "{{\"query\": {{\"bool\": {{\"must\": [{{\"term\": {{\"{c}\": \"{v}\"}}}}]}}}}, \"size\": {n}}}", "MATCH (x:{t})-[:HAS]->(y) WHERE x.{c} = '{v}' RETURN y.{d} LIMIT {n}", "query {{ {t}(where: {{{c}: {{_gt: {n}}}}}) {{ {d} }} }}",
    "for $x in doc('{t}.xml')//{t}[{c} > {n}] return $x/{d}", "PREFIX : <urn:x> ASK {{ ?s :{c} '{v}' ; :{d} ?o }}", "{t}.filter(r => r.{c} > {n}).map(r => r.{d})", "var r = from x in {t} where x.{c} == \"{v}\" select x.{d};", "=SUMIFS({t}!{d}; {t}!{c}; \">{n}\")", "awk -F, '$3 > {n} {{ print $1 }}' {t}.csv | grep {v}",
    "answer(D) :- {t}({c}, D), {c} > {n}.", "def run({t}):\n    return [r['{d}'] for r in {t} if r['{c}'] == '{v}']", "source=\"{t}\" | where {c} > {n} | stats count by {d}", "{t} | where {c} == '{v}' | project {d} | take {n}", "GET /{t}?{c}={v}&fields={d}", "{t}.objects.filter({c}__gt={n}).values('{d}')", "$db->table('{t}')->where('{c}', '{v}')->pluck('{d}');",
]

#: SQL's words in place of its own
TONGUES = [
    {"select": "SCEGLI", "count": "CONTA", "from": "DA", "where": "DOVE", "and": "E", "or": "OPPURE", "join": "UNISCI", "on": "SU", "as": "COME", "order by": "ORDINA PER", "group by": "RAGGRUPPA PER", "between": "TRA", "not in": "NON IN", "in": "DENTRO", "limit": "LIMITE"},
    {"select": "ESCOLHER", "count": "CONTAGEM", "from": "A PARTIR DE", "where": "QUANDO", "and": "MAIS", "or": "OU", "join": "LIGAR", "on": "EM", "as": "CHAMADO", "order by": "CLASSIFICAR POR", "group by": "JUNTAR POR", "between": "DENTRO DE", "not in": "FORA DE", "in": "DENTRE", "limit": "TETO"},
    {"select": "KIES", "count": "TEL", "from": "VAN", "where": "WAARBIJ", "and": "EN", "or": "OF", "join": "KOPPEL", "on": "OP", "as": "ALS", "order by": "SORTEER OP", "group by": "GROEPEER PER", "between": "TUSSEN", "not in": "NIET IN", "in": "BINNEN", "limit": "HOOGSTENS"},
    {"select": "FETCH", "count": "HOWMANY", "from": "OUT OF", "where": "WHEN", "and": "ALSO", "or": "ELSE", "join": "COMBINE", "on": "MATCHING", "as": "CALLED", "order by": "RANKED ON", "group by": "PER", "between": "WITHIN", "not in": "OUTSIDE", "in": "AMONG", "limit": "ATMOST"},
    {"select": "VÄLJ", "count": "ANTAL", "from": "FRÅN", "where": "DÄR", "and": "OCH", "or": "ELLER", "join": "FÖRENA", "on": "PÅ", "as": "SOM", "order by": "ORDNA EFTER", "group by": "GRUPPERA EFTER", "between": "MELLAN", "not in": "INTE I", "in": "I", "limit": "HÖGST"},
    {"select": "WYBIERZ", "count": "POLICZ", "from": "Z", "where": "GDZIE", "and": "ORAZ", "or": "LUB", "join": "DOŁĄCZ", "on": "WEDŁUG", "as": "JAKO", "order by": "SORTUJ", "group by": "GRUPUJ", "between": "POMIĘDZY", "not in": "POZA", "in": "WŚRÓD", "limit": "NAJWYŻEJ"},
]

#: what stands where nothing was answered
VOID = [
    "TODO", "TBD", "FIXME", "N/A", "n.a.", "NULL", "none", "nil", "undefined", "NaN", "empty", "vide", "(vide)", "[none]", "<empty>", "rien", "aucun", "pending", "en attente", "à compléter", "à faire", "sql à compléter", "xxx", "placeholder", "your query here", "insert sql here",
    "requête ici", "pas de réponse", "no query", "sin respuesta", "por hacer", "da completare", "noch offen", "leer", "vacío", "result", "query", "sql", "votre requête", "0", "null;", "blank", "[missing]", "{}", "...", "???",
]

#: what is put around a question that is given back
ECHOES = ["{q}", "-- {q}", "/* {q} */", "# {q}", "Question posée : {q}", "You asked: {q}", "Intitulé - {q}", "« {q} »", "SELECT '{s}'", "Reformulation : {q}", "{l}", "{u}", "{p}"]
