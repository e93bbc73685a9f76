"""Fixed values that results depend on: weights, word lists, patterns. Larger vocabularies are read from files that the caller names."""

# --- fixed values: retrieval and ranking ---
FIELD_BOOSTS = {"title": 1.0, "overview": 2.5, "genres": 1.0, "keywords": 1.0, "tagline": 0.5}
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 15
SEMANTIC_WEIGHT, TEXT_WEIGHT = 1.0, 1.0
VOTES_WEIGHT, UPSTREAM_WEIGHT, AGREEMENT_BONUS = 0.08, 0.12, 0.0
RETRIEVE_POOL, FUSED_POOL, RERANK_POOL = 1500, 800, 100
DESIRED_BONUS, AVOID_PENALTY, COUNTED_HITS = 5, 8, 2
EXPLAINED = 3
CACHE_SECONDS = 3600
GAINS = {3: 1.0, 2: 0.7, 1: 0.3, 0: 0.0}

SYNONYMS = (
    (1, {"astronaut", "space", "mars", "planet", "nasa", "cosmos"}),
    (1, {"stranded", "survive", "survival", "marooned", "alone", "trapped"}),
    (1, {"dream", "dreams", "subconscious", "lucid", "mind"}),
    (1, {"heist", "thief", "steal", "espionage", "robbery"}),
    (1, {"robot", "android", "machine", "automation"}),
    (1, {"girl", "child", "kid", "daughter", "teenager", "12", "young"}),
    (1, {"protect", "protects", "guardian", "guard", "custodian", "defend"}),
    (1, {"hitman", "assassin", "killer", "cleaner", "contract"}),
    (2, {"family", "household", "poor", "rich", "wealthy", "working"}),
    (2, {"simulation", "reality", "virtual", "computer", "hacker"}),
)

#: (all of these groups must have a word in the query, text that is appended)
EXPANSIONS = (
    (({"poor", "unemployed", "working"}, {"rich", "wealthy", "glamorous"}, {"family", "household", "house", "home"}), "unemployed wealthy family working class class differences social satire con artist"),
    (({"hitman", "assassin", "killer", "cleaner"}, {"girl", "child", "kid", "daughter", "young"}, {"protect", "guard", "defend", "guardian"}), "assassin cleaner guardian child protection crime thriller"),
    (({"robot", "android", "machine"}, {"trash", "waste", "earth", "planet"}), "garbage compacting robot abandoned earth environmental science fiction"),
    (({"dream", "subconscious", "mind"}, {"heist", "steal", "thief", "secret"}), "layered dreams mind theft corporate espionage psychological thriller"),
    (({"astronaut", "space", "mars"}, {"stranded", "survive", "survival", "marooned"}), "astronaut accidentally left behind mars survival rescue mission science fiction"),
    (({"boxer", "boxing", "fighter"}, {"train", "training", "steps", "meat", "locker", "champion"}), "underdog boxing training sports drama championship fight"),
    (({"age", "ages", "aging", "backwards", "reverse"}, {"man", "century", "twentieth", "life", "old"}), "reverse aging lifelong romance historical twentieth century unusual birth"),
    (({"palindrom", "backward", "backwards", "reverse", "forward"}, {"timeline", "time", "temporal", "chrono"}), "nonlinear timeline reverse chronology time paradox backwards temporal alternate timeline loop palindromic parallel timeline time manipulation"),
)

DARK_PHRASES = ("horror", "thriller", "slasher", "gore", "torture", "serial killer", "psychological thriller", "disturbing", "violent", "brutal", "nightmare", "terror")

# --- fixed values: moods ---
FILM_MOODS = ("warm", "heartwarming", "feel-good", "uplifting", "hopeful", "funny", "lighthearted", "romantic", "inspiring", "exciting", "thrilling", "suspenseful", "tense", "action-packed", "epic", "mind-bending", "thought-provoking", "dark", "gritty", "bleak", "melancholic", "scary", "disturbing", "bittersweet")
#: category of feeling: (desired, avoid)
MOOD_MAP = {
    "accepting_open": (("thought-provoking", "warm", "uplifting"), ("disturbing",)),
    "aliveness_joy": (("feel-good", "funny", "exciting", "uplifting"), ("bleak",)),
    "angry_annoyed": (("action-packed", "exciting", "funny"), ("melancholic", "bleak")),
    "courageous_powerful": (("epic", "inspiring", "action-packed"), ("bleak",)),
    "connected_loving": (("romantic", "heartwarming", "warm"), ("disturbing",)),
    "curious": (("mind-bending", "thought-provoking", "suspenseful"), ()),
    "despair_sad": (("warm", "heartwarming", "hopeful", "uplifting"), ("bleak", "melancholic", "disturbing")),
    "disconnected_numb": (("heartwarming", "exciting", "inspiring"), ("bleak", "melancholic")),
    "embarrassed_shame": (("funny", "lighthearted", "heartwarming"), ("dark", "disturbing")),
    "fear": (("warm", "lighthearted", "feel-good"), ("scary", "disturbing", "tense")),
    "fragile": (("warm", "heartwarming", "lighthearted"), ("disturbing", "scary", "bleak")),
    "grateful": (("heartwarming", "uplifting", "inspiring"), ()),
    "guilt": (("hopeful", "thought-provoking", "uplifting"), ("bleak",)),
    "hopeful": (("inspiring", "uplifting", "epic"), ("bleak",)),
    "powerless": (("inspiring", "epic", "action-packed"), ("bleak", "disturbing")),
    "tender": (("romantic", "warm", "bittersweet"), ("disturbing",)),
    "stressed_tense": (("lighthearted", "funny", "feel-good", "warm"), ("tense", "dark", "disturbing")),
    "unsettled_doubt": (("feel-good", "hopeful", "warm"), ("mind-bending", "disturbing")),
}
GENRES = ("Action", "Adventure", "Animation", "Comedy", "Crime", "Documentary", "Drama", "Family", "Fantasy", "History", "Horror", "Music", "Mystery", "Romance", "Science Fiction", "TV Movie", "Thriller", "War", "Western")
GENRE_SYNONYMS = (("sci-fi", "Science Fiction"), ("scifi", "Science Fiction"))
INTENT_STOPWORDS = ("a", "an", "and", "also", "but", "feel", "feeling", "for", "i", "im", "in", "is", "it", "like", "me", "mood", "my", "of", "or", "really", "so", "some", "something", "the", "to", "tonight", "very", "want", "watch", "with")
FEELING = r"\b(i'?m|i am|i feel|feel|feeling|felt)\b"
DESIRE = r"\b(want|wanna|need|give me|show me|in the mood for|looking for)\b"

EMOTIONS = {
    "sad": ("sad", "sadness"), "lonely": ("lonely",), "stressed": ("stressed", "stress"), "tired": ("tired",), "anxious": ("anxious", "anxiety"), "bored": ("bored",),
    "heartbroken": ("heartbroken", "heart broken", "shattered"), "exhausted": ("exhausted",), "depressed": ("depressed",), "overwhelmed": ("overwhelmed",),
    "burned_out": ("burned out", "burned-out", "burned_out"), "drained": ("drained",), "frustrated": ("frustrated",), "hopeless": ("hopeless",), "grief": ("grief", "grieving"),
    "melancholy": ("melancholy",), "worried": ("worried",), "afraid": ("afraid",), "helpless": ("helpless",), "ashamed": ("ashamed",), "trapped": ("trapped",), "numb": ("numb",),
    "empty": ("empty",), "disturbed": ("disturbed",),
}
TONES = {
    "cozy": ("cozy",), "gentle": ("gentle",), "warm": ("warm",), "light": ("light",), "funny": ("funny", "comedy", "comedies"), "hopeful": ("hopeful", "hope"), "dark": ("dark",),
    "disturbing": ("disturbing", "disturbingly"), "horror": ("horror",), "devastating": ("devastating",), "raw": ("raw",),
}
DARK_TONES = ("dark", "disturbing", "horror", "devastating")
INTENSIFIERS = ("super", "really", "very", "so", "extremely", "totally", "quite")
#: first match decides
DIRECTIONS = (
    (r"\b(cheer\s+me\s+up|love\s+wins|happily|laugh)\b", "cheer_me_up"),
    (r"\b(calm|drift\s+off|zone\s+out|bad\s+dreams)\b", "calm_me_down"),
    (r"\b(comfort|warm\s+blanket|connection)\b", "comfort_me"),
    (r"\b(funny|absurd|make\s+me\s+laugh)\b", "make_me_laugh"),
    (r"\b(weep|cry|devastating)\b", "help_me_cry"),
    (r"\b(hope|overcomes?|survive)\b", "give_me_hope"),
)

# --- fixed values: explanations ---
EXPLAIN_STOPWORDS = ("a", "an", "the", "about", "of", "to", "and", "or", "is", "are", "was", "were", "be", "been", "being", "i", "we", "you", "they", "he", "she", "it", "in", "on", "at", "for", "with", "by", "as", "from", "that", "this", "those", "these", "movie", "film", "story", "feature", "trying", "someone", "people", "where", "which", "who", "whom", "what", "how", "why", "when", "any", "some", "all")
EXPLAIN_SYNONYMS = (
    ("dream", "nightmare", "lucid", "subconscious"),
    ("reality", "alternate", "waking", "simulation"),
    ("mind", "surreal", "hallucination", "illusion", "thought"),
    ("heist", "thief", "steal", "stolen", "espionage", "robbery"),
    ("space", "mars", "astronaut", "planet", "cosmos", "galaxy"),
    ("survive", "survival", "stranded", "trapped", "marooned"),
    ("cozy", "warm", "gentle", "tender", "comforting", "soothing", "calm", "peaceful"),
    ("uplifting", "hopeful", "inspiring", "heartwarming", "feel-good", "encouraging", "optimistic"),
    ("funny", "comedy", "hilarious", "absurd", "witty", "playful", "lighthearted"),
    ("dark", "disturbing", "intense", "gritty", "devastating", "raw", "unflinching", "bleak"),
    ("emotional", "moving", "touching", "tender", "vulnerable", "heartbreaking", "bittersweet"),
    ("thrilling", "exciting", "adventurous", "daring", "gripping", "suspenseful", "edge-of-seat"),
)
