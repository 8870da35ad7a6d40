"""Vocabularies and parameters of the text operators.

All are defaults: every operator takes its own in place of them.
"""

# Stop words of the French tokeniser.
STOP_WORDS = (
    "le la les de des du un une et en au aux ce ces cette qui que quoi dont où par pour dans sur avec sans sous entre vers chez est sont être avoir fait faire peut il elle ils elles nous vous on se ne pas plus très aussi mais ou donc car si ni je tu "
    "son sa ses leur leurs mon ma mes ton ta tes notre votre tout tous toute toutes même autre autres quel quelle quels quelles comme été ayant après avant lors depuis pendant alors ainsi bien peu trop assez encore déjà jamais rien chaque cet à d l n s c j m t y"
).split()
# Fixed value: a token of the French tokeniser.
TOKEN = "[a-zàâäéèêëïîôùûüÿçœæ0-9]+(?:-[a-zàâäéèêëïîôùûüÿçœæ0-9]+)*"

# Patterns of URLs that are never relevant, and phrases that exclude a text when said twice.
EXCLUDED_URLS = ["/emploi", "/recrutement", "/presse", "/communique", "/contact", "/mentions-legales", "/plan-du-site", "/accessibilite", "/newsletter-inscription"]
EXCLUDED_PHRASES = ["exercer vos droits", "porter plainte en ligne", "vos droits en tant que citoyen", "plainte particulier"]
# Weighted keywords of the relevance score.
KEYWORDS = {
    3: ["dpo", "délégué protection données", "délégué à la protection", "responsable traitement", "sous-traitant", "aipd", "pia", "registre traitement", "analyse impact", "violation données"],
    2: ["rgpd", "gdpr", "protection données", "données personnelles", "traitement données", "base légale", "consentement", "entreprise", "organisme", "professionnel"],
    -2: ["citoyen", "consommateur", "usager", "internaute", "particulier", "plainte en ligne"],
    -1: ["qui sommes-nous", "recrutement", "offre emploi", "communiqué presse", "contact cnil"],
}
# Substrings of a URL and what they add to its score.
URL_SCORES = {2: ["/guide", "/modele", "/outil"], 1: ["/professionnel"], -3: ["/particulier"]}

# Patterns and keywords of the chunk features.
FEATURES = {
    "has_article": r"article\s+\d+",
    "has_legal_ref": r"règlement\s+\(ue\)|directive|loi\s+n°",
    "has_steps": r"étape|procédure|1\.|2\.|3\.",
    "has_template": r"modèle|template|formulaire|checklist",
    "has_sanction": r"san-\d+|amende|mise en demeure",
    "has_technical": r"chiffrement|cryptographie|tls|ssl|https|pseudonymisation|anonymisation|hash|sécurité|mesure technique|authentification|journalisation|accès|contrôle",
}
NUMBERED_LIST = r"(^|\n)\s*\d+\.\s"
DOCTRINE = ["principe", "définition", "notion", "portée", "interprétation", "clarification"]
OPERATIONAL = ["vérifier", "contrôler", "mettre en place", "mesure", "exemple", "cas pratique"]
SECTORS = {
    "Santé": ["dossier médical", "patient", "hôpital", "soin", "santé"],
    "RH": ["salarié", "recrutement", "paie", "ressources humaines"],
    "Marketing": ["prospection", "cookies", "tracking", "publicité"],
    "Éducation": ["école", "université", "étudiant", "élève"],
}
# Sectors of the classification validator.
VALIDATED_SECTORS = {
    "Santé": ["santé", "hôpital", "médical", "patient", "soins"],
    "RH": ["ressources humaines", "employé", "salarié", "recrutement", "paie"],
    "Marketing": ["marketing", "publicité", "prospection", "démarchage"],
    "Éducation": ["éducation", "école", "université", "étudiant", "élève"],
    "Banque": ["banque", "crédit", "compte bancaire", "transaction"],
    "Assurance": ["assurance", "assuré", "police d'assurance", "sinistre"],
}
# Index of each nature, and the default.
NATURE_INDEX = {"DOCTRINE": "FONDAMENTAUX", "GUIDE": "OPERATIONNEL", "SANCTION": "SANCTIONS", "TECHNIQUE": "TECHNIQUE"}
DEFAULT_INDEX = "OPERATIONNEL"

# Phrases of navigation pages.
NAVIGATION = ["En savoir plus", "Lire la suite", "Voir aussi", "Consulter", "En détail", "Accéder", "Découvrir", "Toutes les actualités", "Rechercher", "Affiner la recherche", r"\d+ résultat", r"Page \d+ sur \d+", "Suivant|Précédent"]

# Stance of an answer's first 300 characters.
NEGATIVE = [
    r"(^|[^\p{L}\p{N}_])(non|no)[,.]",
    "n'est pas (possible|autorisé|permis|mobilisable|valable|applicable)",
    "ne peut pas être (utilisé|invoqué|mobilisé|retenu)",
    "ne (peut|doit|saurait) pas",
    "n'est pas une base légale",
    "impossible",
    "interdit",
]
POSITIVE = [r"(^|[^\p{L}\p{N}_])(oui|yes)[,.]", "(peut|peuvent) être (utilisé|invoqué|mobilisé|retenu)", "est possible", "est autorisé", "sous (certaines |)conditions", "sous réserve", "peut (constituer|servir|fonder)"]

# Grounding checks of an answer.
EVASIVE = ["je ne peux pas répondre", "je n'ai pas d'information", "contactez votre dpo", "demandez à votre délégué"]
KNOWN_DATES = ["25 mai 2018", "27 avril 2016"]
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()

# Number words and their digits.
NUMBER_WORDS = dict(zip("zéro un une deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze vingt trente".split(), "0 1 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 20 30".split(), strict=True))
# Words of an ideal, a long and an overlong answer by category, and the factors by intent.
LENGTHS = {"definition": (150, 400, 600), "obligation": (200, 500, 800), "recommandation": (200, 500, 800), "piège": (80, 250, 400), "hors_perimetre": (50, 150, 300)}
DEFAULT_LENGTHS = (200, 500, 800)
INTENT_FACTORS = {"factuel": 1.0, "methodologique": 1.6, "organisationnel": 1.4, "comparaison": 1.3, "cas_pratique": 1.4, "liste_exhaustive": 1.5, "refus": 0.3}

# Topics of the tag vocabulary.
TOPICS = (
    "droits des personnes, consentement, sécurité des données, durée de conservation, sous-traitance, base légale, données sensibles, transfert hors UE, cookies, violation de données, transparence, DPO, vidéosurveillance, "
    "finalité du traitement, registre des traitements, AIPD, anonymisation, minimisation, responsable de traitement, prospection commerciale, conformité RGPD, profilage, sanctions CNIL, données de santé, information des personnes"
).split(", ")

# Acronyms and their expansions (the last meaning of an acronym listed twice).
ACRONYMS = {
    "AIPD": "Analyse d'Impact relative à la Protection des Données",
    "PIA": "Privacy Impact Assessment",
    "EIPD": "Étude d'Impact sur la Protection des Données",
    "DPIA": "Data Protection Impact Assessment",
    "DPO": "Data Protection Officer",
    "DPD": "Délégué à la Protection des Données",
    "RSSI": "Responsable de la Sécurité des Systèmes d'Information",
    "DSI": "Direction des Systèmes d'Information",
    "AFPD": "Agent chargé de la Protection des Données",
    "RGPD": "Règlement Général sur la Protection des Données",
    "GDPR": "General Data Protection Regulation",
    "LIL": "Loi Informatique et Libertés",
    "ePrivacy": "Règlement vie privée et communications électroniques",
    "CNIL": "Cookies et autres traceurs",
    "CEPD": "Comité Européen de la Protection des Données",
    "EDPB": "European Data Protection Board",
    "EDPS": "European Data Protection Supervisor",
    "APD": "Autorité de Protection des Données",
    "ICO": "Information Commissioner's Office",
    "DCP": "Données à Caractère Personnel",
    "BCR": "Binding Corporate Rules",
    "RIG": "Règles Internes Contraignantes",
    "SCC": "Standard Contractual Clauses",
    "CTC": "Clauses Types Contractuelles",
    "CCT": "Clauses Contractuelles Types",
    "DSAR": "Data Subject Access Request",
    "RTBF": "Right To Be Forgotten",
    "DDAC": "Droit d'Accès aux Données",
    "VPD": "Vie Privée par Défaut",
    "DPB": "Data Protection Breach",
    "FSD": "Fuite de Sécurité des Données",
    "PSSI": "Politique de Sécurité des Systèmes d'Information",
    "TIP": "Transfert International de données Personnelles",
    "SCT": "Schéma de Certification des Transferts",
    "GAD": "Garanties Appropriées pour les Données",
    "RTD": "Registre des Traitements de Données",
    "ROPA": "Record of Processing Activities",
    "RVD": "Registre des Violations de Données",
    "PET": "Privacy Enhancing Technologies",
    "PbD": "Privacy by Design",
    "PbDf": "Privacy by Default",
    "VPC": "Vie Privée dès la Conception",
    "IA": "Intelligence Artificielle",
    "AI": "Artificial Intelligence",
    "ML": "Machine Learning",
    "IoT": "Internet of Things",
    "IdO": "Internet des Objets",
    "MPC": "Mise en conformité",
    "POC": "Preuve de Conformité",
    "ACC": "Accountability Conformité Continue",
    "BLT": "Base Légale du Traitement",
    "CI": "Consentement Informé",
    "IM": "Intérêt Légitime",
    "IL": "Intérêt Légitime",
    "OL": "Obligation Légale",
    "EP": "Exécution d'un contrat ou de mesures Précontractuelles",
    "MI": "Mission d'Intérêt public",
    "SV": "Sauvegarde de la Vie",
    "ST": "Sous-Traitant",
    "RT": "Responsable de Traitement",
    "RST": "Responsable et Sous-Traitant",
    "CST": "Contrat de Sous-Traitance",
    "SST": "Sous-Sous-Traitant",
    "SDK": "Software Development Kit",
    "API": "Application Programming Interface",
    "CMP": "Consent Management Platform",
    "PGC": "Plateforme de Gestion du Consentement",
    "DSS": "Données Sensibles de Santé",
    "DDS": "Données de Santé",
    "DBG": "Données Biométriques et Génétiques",
    "DPC": "Données de Profilage et Catégorisation",
    "DGE": "Données de Géolocalisation Exacte",
    "HDS": "Hébergement de Données de Santé",
    "HDH": "Hébergeur de Données de Santé",
    "PaaS": "Platform as a Service",
    "SaaS": "Software as a Service",
    "IaaS": "Infrastructure as a Service",
    "CC": "Certification CNIL",
    "LC": "Label CNIL",
    "ISO": "International Organization for Standardization",
    "ANSSI": "Agence Nationale de la Sécurité des Systèmes d'Information",
    "RH": "Ressources Humaines",
    "GTA": "Gestion des Temps et Activités",
    "CRM": "Customer Relationship Management",
    "GRC": "Gestion de la Relation Client",
    "SIRH": "Système d'Information de Ressources Humaines",
    "ATS": "Applicant Tracking System",
    "LF": "Licéité Finalité",
    "MT": "Minimisation des données et Transparence",
    "EQD": "Exactitude et Qualité des Données",
    "LCD": "Limitation de la Conservation des Données",
    "IS": "Intégrité et Sécurité",
    "CR": "Confidentialité et Responsabilité",
    "MSC": "Mise en demeure CNIL",
    "SE": "Sanction Éducative",
    "SP": "Sanction Pécuniaire",
    "AME": "Amende",
    "REC": "Recours",
    "CIL": "Correspondant Informatique et Libertés",
}

# File type of each media type and extension.
MEDIA_TYPES = {"text/html": "html", "application/pdf": "pdf", "image/jpeg": "image", "image/png": "image", "image/gif": "image", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/plain": "txt"}
EXTENSIONS = {"html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "doc": "docx", "odt": "odt", "ods": "odt", "xlsx": "xlsx", "xls": "xlsx", "txt": "txt", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image"}
SUPPORTED = ["pdf", "docx", "doc", "odt", "xlsx", "xls", "html", "txt"]
