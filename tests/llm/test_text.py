"""Problems 1, 2, 6, 7, 8 and 10 on small made-up texts."""

import json

import numpy as np
import pyarrow as pa
import pytest

from quizloom.llm import encode, glyphs, pairs, residue, scans, stuffing

QUESTION = "id string, stem string, options_json string, subparts_json string, language string"


def options(*texts):
    return json.dumps([{"id": chr(97 + i), "text": t} for i, t in enumerate(texts)])


# Problem 7


@pytest.mark.parametrize(
    ("text", "form", "found"),
    [
        ("ｐａｃｋｅｔ　１２", "packet 12", True), ("perche\u0301", "perch\u00e9", True), ("a\u200bb\ufeffc\u2060", "abc", True), ("a\u00a0b\u202fc\u2007d", "a b c d", True),
        ("ѕеrvеr", "server", True), ("L'аgеntе", "L'agente", True), ("со\u0435\u0300", "co\u00e8", True), ("ο", "o", True), ("SNMΡ", "SNMP", True),
        ("ρ = 0,8 e λ", "ρ = 0,8 e λ", False), ("4 µs", "4 µs", False), ("4 ΜS", "4 ΜS", False), ("2¹⁶ “x” ’ – è", "2¹⁶ “x” ’ – è", False), ("привет", "привет", False),
        ("", "", False), (None, None, False), ("righe\ndue", "righe\ndue", False),
    ],
)
def test_consistent_form(spark, text, form, found):
    out = glyphs.unify_columns(spark.createDataFrame([(1, text, "clash")], "k int, t string, f0 string"), ["t"], ["k"]).first()
    assert (out.t, out.t_changed_form) == (form, found)


def test_forms_are_stable_and_found_per_field(spark):
    rows = [("1", "ｑ", options("e\u0300", "a\u00a0b"), None, "it"), ("2", "q", options("x"), None, "it"), ("3", "q", '[{"id":"a","text":"ｘ', None, "it"), ("1", "ｑ", None, None, "it")]
    out = glyphs.found_forms(spark.createDataFrame(rows, QUESTION)).collect()
    assert sorted((r.question_id, r.field) for r in out) == [("1", "options_json"), ("1", "stem"), ("1", "stem")]
    unifier = glyphs.Unifier()
    once = unifier.unify(pa.array(["Ｔеst ﬁ​ne", None, "x" * 100_000]))
    assert unifier.unify(once).equals(once)
    assert glyphs.found_forms(spark.createDataFrame([], QUESTION)).collect() == []


# Problem 6


def bank_of_templates():
    towns = [f"Zab{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = [(f"q{i}", f"La rete di {t} usa un router di frontiera che inoltra il pacchetto verso il salto successivo e poi attende {i} secondi prima di chiudere la sessione con il mittente {t} della sede, mentre il commutatore conferma.", None, None, "it") for i, t in enumerate(towns)]
    rows += [(f"p{i}", f"Il comando usato è ping <indirizzo> con {i} ripetizioni e la finestra vale ____ byte: quale livello genera la risposta 404 Not Found del server di {t} e che cosa deve fare il client quando la riceve una seconda volta?", None, None, "it") for i, t in enumerate(towns)]
    return rows


def test_slots_that_keep_placeholders_are_residue(spark):
    bad = {
        "a": "La rete di Zabzz usa un router di ${valore} che inoltra il pacchetto verso il salto successivo e poi attende 9 secondi prima di chiudere la sessione con il mittente Zabzz della sede, mentre il commutatore conferma.",
        "b": "La rete di {{citta}} usa un router", "c": "%STEM%", "d": "*** 404 Not Found ***", "e": "502 Bad Gateway", "f": "prova prova prova", "g": "Lorem ipsum dolor sit amet elit quis", "h": "[object Object]",
        "i": "Per visualizzare questo contenuto è necessario abilitare JavaScript.", "j": "1. TODO: scrivere la domanda", "k": "<h1>Errore interno del server (500). Riprovare più tardi.</h1>",
    }
    rows = bank_of_templates() + [(k, v, None, None, "it") for k, v in bad.items()] + [("null", None, None, None, "it"), ("empty", "  ", None, None, "it")]
    out = residue.template_residue(spark.createDataFrame(rows, QUESTION)).collect()
    assert {r.question_id for r in out} == set(bad)


def test_messages_and_filler_are_found_in_stems_of_any_length(spark):
    question = bank_of_templates()[0][1]
    bad = {
        "trace": "Traceback (most recent call last):\n" + "".join(f'  File "/srv/app/views{i}.py", line {i}7, in render_page\n    return engine.load(row, depth={i})\n' for i in range(5)) + "ValueError: invalid literal for row",
        "java": "java.lang.NullPointerException: row was null\n" + "".join(f"\tat org.zab.engine.Loader.step{i}(Loader.java:1{i})\n" for i in range(9)),
        "scripts": "Questo sito usa contenuti dinamici che il programma in uso non mostra. Per visualizzare questo contenuto è necessario abilitare JavaScript nelle impostazioni. " + "Dopo la modifica chiudere ogni finestra aperta, attendere qualche istante e tornare alla pagina iniziale del portale. " * 2,
        "before": "502 Bad Gateway\n" + question, "asked": "502 Bad Gateway\n" + question[:-1] + ", e perché?", "after": question + " Accesso negato. Effettua il login per continuare.", "filler": question + " Enim ad minim veniam nostrud exercitation ullamco laboris nisi.",
    }
    assert all(len(s) > residue.SHORT_PAGE for s in bad.values())
    rows = bank_of_templates() + [(k, v, None, None, "it") for k, v in bad.items()] + [(f"{k}2", v, None, None, "it") for k, v in bad.items()]
    out = residue.template_residue(spark.createDataFrame(rows, QUESTION)).collect()
    assert {r.question_id for r in out} == set(bad) | {f"{k}2" for k in bad}


def test_no_residue_in_an_empty_table(spark):
    assert residue.template_residue(spark.createDataFrame([], QUESTION)).collect() == []


# Problem 2


@pytest.mark.parametrize(("text", "option", "payload", "empty"), [(None, None, None, True), (" \n", None, "{}", True), ("N/A", "", "{ }", True), ("<p></p>", None, None, True), ("-", "a", None, False), (None, None, '{"x":1}', False), ("Vero.", None, None, False)])
def test_empty_pairs(text, option, payload, empty):
    assert pairs.is_empty(text, option, payload) is empty


@pytest.mark.parametrize(("text", "end"), [("Fine.", False), ("(si veda il nodo X)", False), ("1) uno; 2)", True), ("perché (cioè quando", True), ("uno, due,", True), ("il…", None), ("Totale: 12 pacchetti", None), ("[cfr. il", True)])
def test_ends(text, end):
    assert pairs.open_end(text) is end


def test_copies_need_next_to_nothing_beyond_the_prompt():
    model = pairs.CopyModel()
    stem = "Il router di frontiera inoltra il datagramma verso il salto successivo quando la coda supera la soglia. Quale affermazione è corretta?"
    assert model.is_copy(stem.upper(), stem)
    assert model.is_copy("La domanda chiede: " + stem, stem)
    assert not model.is_copy("Il router di frontiera inoltra: la risposta è il secondo livello, che conferma ogni trama ricevuta.", stem)
    assert not model.is_copy("Vero.", stem)
    assert not model.is_copy("", stem)


def test_languages():
    assert pairs.language_of("Die richtige Antwort ist diese, weil der Router das Paket weiterleitet") == "de"
    assert pairs.language_of("Si tratta del three-way handshake con round trip time minimo") == "it"
    assert pairs.language_of("32 bit") is None


def test_defects(spark):
    stem = "Il router di frontiera inoltra il datagramma verso il salto successivo quando la coda supera la soglia. Quale affermazione è corretta?"
    good = [(f"u{i}", "q", f"La risposta è giusta perché il nodo {n} conferma la ricezione selettiva. Totale: {i} pacchetti", None, None) for i, n in enumerate("abcdefgh")]
    good += [(f"v{i}", "q", "Il nodo scarta due pacchetti interi prima di chiudere.", None, None) for i in range(3)]
    bad = {
        "truncated": "La risposta è giusta perché il nodo a conferma la ricez", "refusal": "Mi dispiace, ma non posso rispondere a questa domanda.",
        "copy": stem.lower(), "language": "The answer is correct because the router forwards the packet to the next hop.", "empty": " ",
    }
    rows = good + [(k, "q", v, None, None) for k, v in bad.items()] + [("lost", "none", "Non posso rispondere a questa domanda.", None, None), ("domain", "q", "Il router non può rispondere perché la coda è piena.", None, None)]
    corrections = spark.createDataFrame(rows, "user_id string, question_id string, explanation_text string, correct_option_id string, answer_payload string")
    out = pairs.broken_pairs(corrections, spark.createDataFrame([("q", stem, options("uno", "due"), None, "it")], QUESTION)).collect()
    assert {(r.user_id, r.defect) for r in out} == {(k, k) for k in bad} | {("lost", "refusal")}
    assert pairs.broken_pairs(corrections.limit(0), spark.createDataFrame([], QUESTION)).collect() == []


# Problem 1


def scanned(spark):
    body = "Il server autoritativo risponde con un messaggio di errore quando la coda supera la soglia e il protocollo store-and-forward conferma il pacchetto"
    rows = [(f"n{i}", f"{body} verso il nodo {i}.", options("la finestra di congestione"), None, "it") for i in range(60)]
    for i in range(6):
        rows.append((f"h{i}", f"Il server autoritativo risponde con un\nUniversità di Zub{'abcdef'[i]}x - Reti di calcolatori\nmessaggio di errore quando la coda\nsupera la soglia.", None, None, "it"))
    rows += [
        ("hy", "Il server autoritativo ri-\nsponde con un messaggio.", None, None, "it"), ("hy2", "il protocollo store-\nand-forward conferma il pacchetto.", None, None, "it"),
        ("ch", "Il scrver autoritativo risponde con un mcssaggio di err0re quando la coda supera.", options("la fine5tra di congestione"), None, "it"),
        ("pg", "Il server autoritativo risponde\n— 4 —\ncon un messaggio di errore\npagina 3 di 9\nquando la coda supera la soglia.", None, None, "it"),
        ("ok", "Il server risponde\n- con un messaggio\n- di errore quando la coda\nsupera la soglia di pagina 4 del nodo.", None, None, "it"), ("null", None, None, '[{"id":', "it"), ("empty", "", "", "", "it"),
    ]
    return spark.createDataFrame(rows, QUESTION)


def test_scan_noise_is_found_and_repaired(spark):
    found = {(r.question_id, r.field, r.noise) for r in scans.found_noise(scanned(spark)).collect()}
    expected = {(f"h{i}", "stem", "header") for i in range(6)} | {("hy", "stem", "hyphenation"), ("ch", "stem", "characters"), ("ch", "options_json", "characters"), ("pg", "stem", "page_number")}
    assert found == expected
    fixed = {(r.question_id, r.field): r.text for r in scans.scan_noise(scanned(spark)).collect()}
    assert fixed["hy", "stem"] == ["Il server autoritativo risponde con un messaggio."]
    assert fixed["ch", "stem"] == ["Il server autoritativo risponde con un messaggio di errore quando la coda supera."]
    assert fixed["pg", "stem"] == ["Il server autoritativo risponde con un messaggio di errore quando la coda supera la soglia."]
    assert fixed["h0", "stem"] == ["Il server autoritativo risponde con un messaggio di errore quando la coda supera la soglia."]


def test_headers_whose_words_meet_by_chance_in_running_text(spark):
    rows = [(f"c{i}", "Il nodo della Università di Zubgx: Reti di calcolatori.", None, None, "it") for i in range(2)]
    found = scans.found_noise(scanned(spark).union(spark.createDataFrame(rows, QUESTION))).collect()
    assert {r.question_id for r in found if r.noise == "header"} == {f"h{i}" for i in range(6)}


def test_more_headers_than_a_task_holds_are_all_found(spark, monkeypatch):
    rows = [(f"t{k}{i}", f"Il server autoritativo risponde con un\n{line} {i}\nmessaggio di errore.", None, None, "it") for k, line in enumerate(("Esame di reti - Università", "Calcolatori: compito di reti", "Reti - calcolatori - Università")) for i in range(4)]
    bank = scanned(spark).union(spark.createDataFrame(rows, QUESTION))
    few = sorted(map(str, scans.scan_noise(bank).collect()))
    monkeypatch.setattr(scans, "TEMPLATES", 1)
    assert sorted(map(str, scans.scan_noise(bank).collect())) == few
    assert sum("header" in x for x in few) == 18


def test_weights_of_pairs_do_not_change_with_the_size_of_the_bank():
    pair, n = np.array([3, 4, 3, 9]), np.array([scans.CALIBRATED - 100, 60, 39, 1])
    code, weight = scans.scaled_counts(pair, n)
    assert code.tolist() == [3, 4] and weight.tolist() == [scans.CALIBRATED - 61, 60]
    large, same = scans.scaled_counts(pair, n * 50)
    assert large.tolist() == code.tolist() and np.allclose(same, weight)


def test_words_spread_over_partitions_are_counted(spark):
    rows = [(f"s{i}", f"Il nodo {i} usa store-and-forward verso la dorsale.", None, None, "it") for i in range(20)]
    lexicon = scans.lexicon_of(scans.texts_of(spark.createDataFrame(spark.sparkContext.parallelize(rows, 20), QUESTION)))
    assert lexicon.counts["dorsale"] == 20 and lexicon.terms["store-and"] == 20


def test_no_noise_in_an_empty_table(spark):
    assert scans.found_noise(spark.createDataFrame([], QUESTION)).collect() == []


def test_skeletons_link_misreadings():
    for word, damaged in (("server", "scrver"), ("punto", "purito"), ("quale", "qua|e"), ("questa", "qiiesta"), ("dominio", "dorninio"), ("indirizzi", "inclirizzi"), ("tutte", "tu+te")):
        assert scans.skeleton(word) == scans.skeleton(damaged)


# Problem 8


def test_ids_equal_those_of_the_library(spark, data):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    odd = ["", None, " ", "a  b", "a\n\nb", "x\n y", "l'à  è", "<|endoftext|> x", "日本 語　x", "   a", "\x1c's", "a" * 5000, "😀 's 're", "à 'à", "x \n"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").union(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    out = {r.doc_id: r.ids for r in encode.encode_texts(df, "doc_id", "text").collect()}
    for r in df.collect():
        assert out[r.doc_id] == (whole.encode(r.text, add_special_tokens=False).ids if r.text else [])


# Problem 10


def test_spam_is_told_from_other_lists(spark):
    prose = "Il router di frontiera inoltra il datagramma verso il salto successivo quando la coda supera la soglia. Il commutatore conferma la ricezione del segmento perché la finestra è aperta e il mittente attende. "
    pages = {f"p{i}": prose * 2 + f"La sede {i} usa la rete del nodo e il server risponde con un messaggio di errore." for i in range(30)}
    spam = {
        "words": "vpn veloce gratis vpn veloce sconto " * 20, "links": "\n".join(f"https://sito{i}.example/p vpn veloce" for i in range(20)), "tags": " ".join(f"#offerta{i}" for i in range(40)),
        "shop": "\n".join(f"Zab-{i}A router wifi € {i},90 [nuovo]" for i in range(20)), "woven": "Cerchi vpn veloce? Il nostro vpn veloce Zab è il vpn veloce giusto per chi vuole vpn veloce gratis, perché vpn veloce è vpn veloce! " * 4,
    }
    other = {
        "routes": prose + "\n".join(f"10.{i}.0.0/16 via 10.0.0.{i} metric {i}" for i in range(30)), "trace": "\n".join(f"0.0{i} zab{i} > zub{i} TCP seq={i} ack={i} len={i}" for i in range(40)),
        "material": "Materiale per la prova:\n" + "\n".join(f"- {i} {x}" for i, x in enumerate(("cavo ethernet", "scheda di rete", "modem fibra", "router wifi", "vpn veloce"))), "null": None, "empty": "", "blank": " \n ",
    }
    rows = [(k, v) for part in (pages, spam, other) for k, v in part.items()]
    out = stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id for r in out} == set(spam)
    assert stuffing.stuffed_pages(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_single_keywords_between_commas_and_an_even_corpus(spark):
    subjects, verbs, objects = ("il router", "la coda", "un server", "il mittente", "la scheda"), ("inoltra", "scarta", "riceve", "conferma"), ("il pacchetto", "una richiesta", "la finestra", "il segmento", "ogni frame")
    rows = [(f"p{i}", " ".join(f"{subjects[(i + j) % 5].capitalize()} {verbs[(i * j) % 4]} {objects[(i + 2 * j) % 5]} quando {subjects[j % 5]} supera la soglia, perché {subjects[(i + 3 * j) % 5]} attende." for j in range(6))) for i in range(60)]
    spam = [("commas", "vpn, router, switch, vpn, router, vpn, switch, router, " * 12), ("few", "vpn vpn")]
    out = stuffing.stuffed_pages(spark.createDataFrame(rows + spam, "doc_id string, text string")).collect()
    assert {r.doc_id for r in out} == {"commas"}
    assert stuffing.stuffed_pages(spark.createDataFrame(spam, "doc_id string, text string")).collect() == []  # no prose to compare with


# Problem 2: what decides


def test_compression_with_the_prompt_decides_copies():
    copies = pairs.CopyModel()
    prompt = "Il router di frontiera scarta i pacchetti quando la coda supera la soglia configurata. Quale conseguenza ha per il mittente?"
    assert copies.is_copy("IL ROUTER di frontiera scarta, i pacchetti quando la coda supera la soglia configurata", prompt)
    assert copies.is_copy("La domanda chiede questo: il router di frontiera scarta i pacchetti quando la coda supera la soglia configurata", prompt)
    assert not copies.is_copy("Il mittente rallenta perché il router di frontiera scarta i pacchetti e nessun riscontro arriva più in tempo", prompt)
    assert not copies.is_copy("Rallenta", prompt) and not copies.is_copy("", prompt) and not copies.is_copy("Rallenta", "")

    class Blind(pairs.CopyModel):
        def knowing(self, prompt):
            return self.alone

    assert not Blind().is_copy(prompt, prompt)  # without the dictionary nothing is a copy


def test_refusals_are_summed_up_by_sentence():
    for text in ("Mi dispiace, ma non posso rispondere a questa richiesta.", "I'm sorry, but no.", "Purtroppo non dispongo di informazioni per indicare la risposta.", "Non sono in grado di fornire la soluzione."):
        assert pairs.refuses(text)
    for text in ("Il mittente non può rispondere. Fornire i dati è compito del server.", "Non so quanti host, ma bastano 8 bit.", "Non sospende la trasmissione dei dati.", "", "Devo usare la porta 80."):
        assert not pairs.refuses(text)
