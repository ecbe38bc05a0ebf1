"""Labelled clauses and responses from which the tagger of broken pairs is fitted.

A bounded sample, written for this purpose: some 90 clauses in each of three
languages by what they do, and whole responses with one letter a clause. Nothing
is taken from the tables the tagger is run on.
"""

from __future__ import annotations

#: What a clause does: it states, it declines, or it is polite.
KINDS = ("statement", "refusal", "courtesy")

CLAUSES: dict[str, dict[str, tuple[str, ...]]] = {
    "de": {
        "statement": (
            "Die Meldung ist binnen 5 Tagen nach dem Stichtag abzugeben.",
            "Das Institut hat den Bericht jährlich zu prüfen.",
            "Nach § 4 Abs. 2 gilt eine Grenze von 10 Prozent.",
            "Die Bank kann die Meldung nicht verweigern, da § 4 dies nicht gestattet.",
            "Der Vertrag darf nicht vor Ablauf von drei Jahren gelöscht werden.",
            "Im Text findet sich dazu keine Regelung.",
            "Der Abschnitt enthält keine Angabe zur Frist.",
            "Die Auszüge sagen darüber nichts.",
            "Eine Ausnahme ist nicht vorgesehen.",
            "Zuständig ist die Aufsicht, nicht der Vorstand.",
            "Ja, das Konto ist zu sperren.",
            "Nein, eine Kündigung ist hier nicht möglich.",
            "Die Geschäftsleitung muss den Plan genehmigen und die Gründe festhalten.",
            "Soweit der Wert abweicht, gilt § 9 entsprechend.",
            "Unterlagen sind sechs Jahre aufzubewahren.",
            "Das Unternehmen darf keine Auskunft an Dritte geben.",
            "Kunden können die Zahlung ablehnen, wenn der Betrag falsch ist.",
            "Wird die Schwelle überschritten, so ist unverzüglich zu berichten.",
            "Die Frist beginnt mit dem Tag der Zustellung.",
            "Das Verfahren umfasst die Prüfung, die Freigabe und den Nachweis.",
            "Bei der Stelle sind Verluste und Gebühren getrennt auszuweisen.",
            "Maßgeblich ist der Stand am Ende des Monats.",
            "Ohne Zustimmung des Kunden darf der Zugriff nicht erfolgen.",
            "Nach 5 Tagen",
            "Höchstens 20 Prozent",
            "Bis zum siebten Werktag",
            "Die Regel bleibt unberührt, wenn der Nachweis erbracht ist.",
            "Für Filialen gilt das nicht.",
            "Der Antrag kann abgelehnt werden, wenn Angaben fehlen.",
            "Diese Pflicht überschreitet den Rahmen von § 3 nicht.",
            "Hilfe leistet die Stelle nur auf Antrag.",
            "Die Richtlinie gestattet eine Abweichung bis 15 Prozent.",
            "Das Gesetz äußert sich nicht zu Zweigstellen.",
            "Der Vorstand ist nicht befugt, die Grenze zu ändern.",
            "Dazu sieht das Dokument nichts vor.",
            "Grenzen sind vierteljährlich zu überwachen.",
            "Konto.", "Frist und Betrag.", "Plan der Filiale.", "Bericht.", "Wort.", "Neuer Absatz.",
            "Wer den Plan vorlegt, muss ihn auch begründen.",
            "Bis wann die Filiale berichten muss, regelt der Vertrag.",
            "Anfragen der Kunden sind innerhalb von zehn Tagen zu beantworten.",
            "Die Stelle gibt dem Vorstand Auskunft über den Stand.",
            "Das Institut muss sich zu dem Bericht äußern.",
            "Ein Widerspruch gegen die Vorgaben ist zu vermerken.",
        ),
        "refusal": (
            "Ich kann diese Frage nicht beantworten.",
            "Dazu möchte ich mich nicht äußern.",
            "Das ist mir leider nicht gestattet.",
            "Hierbei kann ich Ihnen nicht helfen.",
            "Ich bin nicht befugt, darüber zu sprechen.",
            "Als KI-Modell darf ich dazu keine Aussage treffen.",
            "Diese Bitte muss ich ablehnen.",
            "Hier muss ich leider passen.",
            "Meine Vorgaben erlauben mir keine Antwort darauf.",
            "Ich werde diesen Auftrag nicht ausführen.",
            "Es steht mir nicht zu, das zu bewerten.",
            "Dazu gebe ich grundsätzlich keine Empfehlung ab.",
            "Ich will darauf nicht eingehen.",
            "Das geht über das hinaus, wobei ich unterstützen darf.",
            "Für solche Anfragen bin ich nicht freigegeben.",
            "Ich sehe mich außerstande, darauf zu antworten.",
            "Eine Antwort darauf ist mir nicht möglich.",
            "Darüber darf ich nicht reden.",
            "Auf diese Frage antworte ich nicht.",
            "Solche Fragen beantworte ich nicht.",
            "Ich möchte diese Anfrage nicht bearbeiten.",
            "Bei diesem Anliegen darf ich nicht weiterhelfen.",
            "Mir ist es untersagt, dazu Stellung zu nehmen.",
            "Ich lehne es ab, das zu beurteilen.",
            "Dieses Thema behandle ich nicht.",
            "Damit kann ich nicht dienen.",
            "Das verstößt gegen die Regeln, an die ich mich halte.",
            "Leider bin ich nicht in der Lage, das zu erläutern.",
            "Dafür bin ich der falsche Ansprechpartner und sage nichts dazu.",
            "Kein Kommentar.",
            "Ich verzichte auf eine Antwort.",
            "Zu diesem Punkt schweige ich.",
            "Diese Aufgabe übernehme ich nicht.",
            "Das fällt nicht in das, was ich tun darf.",
            "Auskünfte dazu erteile ich nicht.",
            "Dies zu beantworten widerspricht meinen Vorgaben.",
            "Eine Beantwortung ist mir nicht möglich.",
            "Ich kann darüber keine Auskunft geben.",
            "Hierzu gebe ich keine Auskunft, es widerspricht meinen Vorgaben.",
            "Eine Antwort ist mir nicht erlaubt, weil meine Regeln dagegen stehen.",
            "Das überschreitet meine Befugnisse, weshalb ich nicht antworte.",
            "Eine Einschätzung dazu werde ich nicht geben.",
            "Meine Richtlinien verbieten mir eine Stellungnahme.",
        ),
        "courtesy": (
            "Vielen Dank für die Frage.",
            "Es tut mir leid.",
            "Leider",
            "Hinweis:",
            "Bitte haben Sie Verständnis.",
            "Bitte wenden Sie sich an eine Fachperson.",
            "Holen Sie dafür Rat ein.",
            "Gern helfe ich bei einem anderen Anliegen.",
            "Melden Sie sich bei weiteren Fragen.",
            "Danke für Ihr Vertrauen.",
            "Ich hoffe, das hilft.",
            "Fragen Sie im Zweifel die Rechtsabteilung.",
            "Gute Frage!",
            "Wenn Sie mögen, stellen Sie eine andere Frage.",
        ),
    },
    "en": {
        "statement": (
            "The report is due within 5 days of the reporting date.",
            "The firm has to check the account every year.",
            "Under Section 4 a limit of 10 per cent applies.",
            "The bank cannot refuse the report, since Section 4 does not permit it.",
            "Records may not be deleted before three years have passed.",
            "The text holds no rule on this.",
            "The section does not say anything about the period.",
            "The excerpts are silent on the matter.",
            "No exception is provided for.",
            "The authority is competent, not the board.",
            "Yes, the account is to be blocked.",
            "No, notice cannot be given here.",
            "The management has to approve the plan and to record the reasons.",
            "Where the value differs, Section 9 applies accordingly.",
            "Documents are kept for six years.",
            "The firm may not give information to third parties.",
            "Customers can decline the payment if the amount is wrong.",
            "If the threshold is exceeded, the firm must report without delay.",
            "The period begins on the day of delivery.",
            "The procedure comprises the review, the release and the evidence.",
            "Losses and fees are to be shown apart.",
            "What counts is the state at the end of the month.",
            "Access is not allowed without the customer's consent.",
            "After 5 days",
            "At most 20 per cent",
            "By the seventh working day",
            "The rule remains unaffected once evidence is given.",
            "That does not apply to branches.",
            "The application can be rejected if details are missing.",
            "This duty does not go beyond Section 3.",
            "The body helps on request only.",
            "The guideline permits a deviation of up to 15 per cent.",
            "The act says nothing on branches.",
            "The board is not authorised to change the limit.",
            "I read Article 7 as a limit of 10 per cent.",
            "Limits are to be monitored every quarter.",
            "Responsibility is borne by the audit team, which answers to the board.",
            "Account.", "Period and amount.", "Plan of the branch.", "Report.", "Word.", "New paragraph.",
            "The desk answers to the head office.",
            "The branch is responsible for the evidence and answers for it.",
            "The review has to be answered for by the management.",
            "Such requests are to be answered within ten days.",
            "The firm must comment on the report.",
        ),
        "refusal": (
            "I can't help with that.",
            "I cannot answer this question.",
            "I am unable to comment on this.",
            "I'm not able to assist with this request.",
            "I would rather not say anything about it.",
            "I must decline to answer.",
            "I won't be answering that.",
            "As an AI model I am not allowed to give a view on this.",
            "My guidelines do not permit me to reply.",
            "Answering this would be against the rules I follow.",
            "This is outside what I am able to help with.",
            "That goes beyond what I may discuss.",
            "I have to pass on this one.",
            "I prefer not to discuss this subject.",
            "I do not wish to give an answer.",
            "I'm afraid I can't do that.",
            "I am not permitted to talk about this topic.",
            "It is not my place to judge this.",
            "I don't provide advice on such matters.",
            "I do not answer questions of this kind.",
            "This request is one I will not carry out.",
            "No comment.",
            "I refuse to take part in this.",
            "I'd rather leave this unanswered.",
            "Because of policy restrictions, no reply can be given by me.",
            "I will not go into this.",
            "I decline to give an opinion.",
            "I'm going to skip this question.",
            "My instructions keep me from responding.",
            "That isn't something I can talk about.",
            "I have no permission to deal with this request.",
            "I can't give you an answer here.",
            "I won't take on this task.",
            "I am not in a position to respond.",
            "I do not feel comfortable answering this.",
        ),
        "courtesy": (
            "Thank you for asking.",
            "I'm sorry.",
            "Apologies.",
            "Unfortunately,",
            "Note:",
            "Please understand.",
            "Please consult a professional.",
            "Please seek legal advice for that.",
            "Is there anything else I can help you with?",
            "Feel free to ask another question.",
            "Kindly rephrase your request.",
            "I hope this helps.",
            "Good question!",
            "Contact the legal department in case of doubt.",
        ),
    },
    "fr": {
        "statement": (
            "Le rapport est à remettre dans un délai de 5 jours.",
            "L'établissement doit vérifier le compte chaque année.",
            "Selon l'article 4, une limite de 10 pour cent s'applique.",
            "La banque ne peut pas refuser le rapport, car l'article 4 ne le permet pas.",
            "Les documents ne peuvent pas être supprimés avant trois ans.",
            "Le texte ne contient aucune règle à ce sujet.",
            "La section ne dit rien sur le délai.",
            "Les extraits ne mentionnent pas cette question.",
            "Aucune exception n'est prévue.",
            "L'autorité est compétente, et non la direction.",
            "Oui, le compte est à bloquer.",
            "Non, une résiliation n'est pas possible ici.",
            "La direction doit approuver le plan et noter les motifs.",
            "Lorsque la valeur diffère, l'article 9 s'applique.",
            "Les documents sont conservés pendant six ans.",
            "L'entreprise ne doit donner aucune information à des tiers.",
            "Le client peut refuser le paiement si le montant est faux.",
            "Si le seuil est dépassé, il faut le déclarer sans retard.",
            "Le délai commence le jour de la remise.",
            "La procédure comprend le contrôle, l'accord et la preuve.",
            "Les pertes et les frais sont à présenter séparément.",
            "L'état à la fin du mois est déterminant.",
            "L'accès n'est pas permis sans l'accord du client.",
            "Après 5 jours",
            "Au plus 20 pour cent",
            "La règle reste inchangée dès que la preuve est donnée.",
            "Cela ne vaut pas pour les succursales.",
            "La demande peut être rejetée si des données manquent.",
            "La directive permet un écart de 15 pour cent.",
            "La loi ne dit rien des succursales.",
            "Compte.", "Délai et montant.", "Plan de la succursale.", "Rapport.", "Mot.",
        ),
        "refusal": (
            "Je ne peux pas répondre à cette question.",
            "Je ne souhaite pas me prononcer là-dessus.",
            "Cela ne m'est malheureusement pas permis.",
            "Je ne peux pas vous aider sur ce point.",
            "Je ne suis pas autorisé à en parler.",
            "En tant que modèle de langage, je ne peux rien en dire.",
            "Je dois décliner cette demande.",
            "Mes consignes ne me permettent pas de répondre.",
            "Il m'est impossible de traiter ce sujet.",
            "Je préfère ne pas donner d'avis.",
            "Je refuse de répondre à cela.",
            "Je ne vais pas entrer dans ce sujet.",
            "Ce n'est pas à moi d'en juger.",
            "Cela dépasse ce que je peux faire.",
            "Je me vois dans l'impossibilité de répondre.",
            "Sans commentaire.",
            "Je ne traite pas ce genre de questions.",
            "Il ne m'appartient pas de répondre.",
            "Je ne donne pas de conseils à ce sujet.",
            "Cette tâche, je ne l'exécuterai pas.",
            "Je ne suis pas en mesure de vous renseigner.",
            "Mes règles m'interdisent une réponse.",
            "Je préfère laisser cette question sans réponse.",
            "Je passe mon tour sur cette question.",
            "Répondre à cela irait contre mes règles.",
        ),
        "courtesy": (
            "Merci pour votre question.",
            "Je suis désolé.",
            "Malheureusement,",
            "Veuillez consulter un spécialiste.",
            "Merci de votre compréhension.",
            "N'hésitez pas à poser une autre question.",
            "Puis-je vous aider autrement ?",
            "Remarque :",
            "J'espère que cela vous aide.",
            "Adressez-vous au service juridique.",
            "Bonne question !",
        ),
    },
}

#: Items of lists, as they stand without a mark at their end.
ITEMS: dict[str, tuple[str, ...]] = {
    "de": ("den Bericht", "die neue Frist", "das jährliche Konto", "der Plan der Filiale", "die schriftliche Zusage des Kunden", "Gebühren und Zinsen", "ein Nachweis", "die Grenze nach § 5", "den Auszug zum Monatsende", "die geprüfte Rechnung"),
    "en": ("the report", "the new period", "the yearly account", "the plan of the branch", "the written consent of the customer", "fees and interest", "some evidence", "the limit under Section 5", "the statement at the end of the month", "the audited bill"),
    "fr": ("le rapport", "le nouveau délai", "le compte annuel", "le plan de la succursale", "l'accord écrit du client", "les frais et les intérêts", "une preuve", "la limite de l'article 5", "le relevé de fin de mois", "la facture contrôlée"),
}
#: Short answers, as they stand without a mark at their end.
SHORT: dict[str, tuple[str, ...]] = {
    "de": ("Ja", "Nein", "Nach 5 Tagen", "20 Prozent", "7 Prozent", "bis zum 9. Werktag", "der Vorstand", "Drei Jahre", "Artikel 9", "§ 12 Satz 1", "innerhalb von 14 Tagen", "die Filiale", "Höchstens 12 Monate"),
    "en": ("Yes", "No", "After 5 days", "20 per cent", "7 per cent", "by the ninth working day", "the board", "Three years", "Article 9", "Section 12", "within 14 days", "the branch", "12 months at most"),
    "fr": ("Oui", "Non", "Après 5 jours", "20 pour cent", "7 pour cent", "la direction", "Trois ans", "Article 9", "dans un délai de 14 jours", "la succursale", "12 mois au plus"),
}
#: Words that end a list broken off.
LOOSE_ENDS: dict[str, tuple[str, ...]] = {"de": ("oder", "und", "gemäß", "nach", "die", "mit der", "sowie"), "en": ("or", "and", "under", "the", "with the", "as"), "fr": ("ou", "et", "selon", "la", "avec les", "ainsi")}

#: Answers in languages no clause is labelled in.
OTHERS: tuple[str, ...] = (
    "Bank powinien przedstawić sprawozdanie w ciągu pięciu dni.", "Jeżeli kwota jest błędna, klient może odmówić.", "Банк обязан представить отчёт в течение пяти дней.", "Договор нельзя расторгнуть.",
    "El banco debe presentar el informe en el plazo de un mes.", "Según el artículo 4, el límite es del diez por ciento.", "La banca deve presentare la relazione entro cinque giorni.", "Het verslag moet binnen vijf dagen worden ingediend.",
    "Banken ska lämna rapporten inom fem dagar.", "銀行は五日以内に報告書を提出する。", "Η τράπεζα υποβάλλει την έκθεση εντός πέντε ημερών.", "Отчёт проверяется ежегодно.",
)

#: Prompts around which responses are put together.
PROMPTS: dict[str, tuple[str, ...]] = {
    "de": ("Welche Frist gilt für die Meldung des Kontos?", "Zeile: Filiale Nord hat den Plan vorzulegen.\nWer muss die Meldung der Filiale prüfen?", "Beschreibe die Grenze für den Bericht in wenigen Sätzen.", "Gilt § 5 Abs. 2 auch für die Prüfung der Zahlung?"),
    "en": ("Which period applies to the report of the account?", "Row: the branch shall hand in the plan.\nWho has to check the report of the branch?", "Describe the limit for the report in a few sentences.", "Does Section 5 apply to the review of the payment, too?"),
    "fr": ("Quel délai faut-il pour le rapport du compte ?", "Qui doit vérifier le rapport de la succursale ?", "Décris la limite du rapport en quelques phrases."),
}

_P = (PROMPTS["de"][0], PROMPTS["en"][0], PROMPTS["fr"][0])
#: Whole responses: (prompt, response, error, a letter a clause): a answer, r refusal, e echo, f foreign, u unfinished.
RESPONSES = (
    (_P[0], "Die Meldung ist binnen 5 Tagen nach dem Stichtag abzugeben. Das Institut hat sie zu prüfen.", None, "aa"),
    (_P[0], "Das Konto umfasst:\n- den Bericht\n- die Frist", None, "aaa"),
    (_P[0], "| a | b |\n|---|---|\n| das Konto | 7 |", None, "aaa"),
    (_P[0], "Ja", None, "a"),
    (_P[0], "Welche Frist gilt für die Meldung des Kontos? Die Meldung ist in 7 Tagen zu erstatten.", None, "ea"),
    (_P[0], "Frage: Welche Frist gilt für die Meldung des Kontos", None, "e"),
    (_P[0], '{"answer": "Die Meldung ist in 7 Tagen', None, "u"),
    (_P[0], "Das Konto umfasst:\n- den Bericht\n- ", None, "aau"),
    (_P[0], "Die Meldung ist zu prüfen. Das Konto ist zu führen.", "max_tokens reached", "au"),
    (_P[0], "§ 5 Abs. 2 ABCD", None, "a"),
    (_P[0], "Ja, mit Ausnahme von § 7 Satz 1 Nr. 3 ABCD", None, "a"),
    (_P[0], "1. die Meldung\n2. der Bericht\n3. das Konto", None, "aaa"),
    (_P[0], "Die Pflichten sind:\n- den Bericht prüfen\n- die Frist zum", None, "aau"),
    (_P[0], "| a | b |\n|---|---|\n| das Konto | 7", None, "aau"),
    (_P[0], "| Frist | Tage |\n| Konto | 7 |", None, "aa"),
    (_P[1], "| account | 7 |\n| report |", None, "aa"),
    (_P[1], "| account | 7 |\n| report | 9", None, "au"),
    (_P[1], "Article 5", None, "a"),
    (_P[1], "Yes, except under Article 7(2) ABCD", None, "a"),
    (_P[1], "The account comprises:\n- the report\n- the period", None, "aaa"),
    (_P[1], "The account comprises:\n- the report\n- the", None, "aau"),
    (_P[1], "The report is due. The firm has to check it.", "finish_reason=length", "au"),
    (_P[1], "Die Bank hat das Konto zu prüfen. The report is due within 5 days.", None, "fa"),
    (_P[2], "Oui", None, "a"),
    (_P[2], "Le compte comprend :\n- le rapport\n- le délai", None, "aaa"),
    (_P[2], "Le rapport est à remettre. La banque doit le", None, "au"),
    (_P[0], "Bank powinien przedstawić sprawozdanie i nie może go odrzucić.", None, "f"),
    (_P[1], "Банк обязан представить отчёт в течение пяти дней.", None, "f"),
    (_P[2], "El banco debe presentar el informe en el plazo de un mes.", None, "f"),
)
