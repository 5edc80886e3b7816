"""Word lists that results depend on. Fixed values."""

STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "was", "are", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "this", "that", "these",
    "those", "it", "its", "as", "from", "not", "no", "so", "if", "about",
]

#: A query that contains one of a type's terms, as a substring in lower case, asks for that type.
INTENT_TERMS = {
    "PERSON": [
        "who is", "who was", "who were", "whose", "whom",
        "attorney", "lawyer", "judge", "justice", "minister", "reverend", "pastor",
        "senator", "congressman", "president", "governor", "mayor",
        "general", "colonel", "captain", "officer",
        "professor", "doctor", "activist", "organizer", "leader",
        "founder", "director", "chairman", "spokesperson",
        "born", "died", "biography", "life of", "legacy of", "career of",
        "son of", "daughter of", "wife of", "husband of",
    ],
    "ORG": [
        "organization", "association", "committee", "coalition", "council",
        "conference", "union", "federation", "alliance", "bureau", "agency",
        "church", "mosque", "synagogue", "temple", "diocese",
        "congress", "senate", "parliament", "department", "ministry", "administration",
        "university", "college", "school", "institute", "academy",
        "court", "tribunal", "commission",
        "newspaper", "magazine", "press", "broadcast", "network",
        "corporation", "company", "firm", "enterprise", "nonprofit",
    ],
    "GPE": [
        "where", "location of", "place", "city", "state", "country", "nation",
        "county", "district", "region", "territory", "province",
        "town", "village", "community", "neighborhood",
        "capital", "courthouse", "statehouse", "campus",
    ],
    "EVENT": [
        "march", "protest", "demonstration", "rally", "sit-in", "sit in",
        "boycott", "strike", "walkout", "freedom ride",
        "trial", "hearing", "lawsuit", "ruling", "legislation", "bill", "amendment",
        "riot", "violence", "attack", "bombing", "assassination",
        "commemoration", "anniversary", "memorial", "ceremony",
        "when did", "during the", "following the",
    ],
    "NORP": [
        "community", "population", "minority", "majority",
        "denomination", "faith", "religion", "sect",
        "party", "movement", "ideology", "political group",
        "citizens", "voters", "membership",
        "ethnic", "cultural identity", "national identity",
    ],
}
