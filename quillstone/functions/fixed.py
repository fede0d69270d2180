"""Values that records, messages and templates must carry exactly as given."""

# Domains of the pair metadata.
REQUIRED_FIELDS = ("pair_id", "shape", "volume_cc", "view", "consent_ref")
SHAPES = ("round", "teardrop")
VIEWS = ("front", "oblique-left", "oblique-right", "side-left", "side-right")
BRAND_CODES = ("mentor", "natrelle", "motiva", "sientra", "other", "unknown")
PROFILE_CODES = ("moderate", "moderate-plus", "high", "extra-high", "unknown")
CLOTHING = ("nude", "bra", "top")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
INGEST_VOLUME = (100, 1000)
MIN_DIMENSION = 512

# Limits of the request guard and the limiter.
MIME_TYPES = ("image/jpeg", "image/png", "image/webp")
EXTENSION_BY_MIME = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
MAX_BODY_BYTES = 12_500_000
MAX_BASE64 = 11_000_000
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_SIDE = 1536
PREVIEW_VOLUME = (150, 800)
RATE_LIMIT, RATE_WINDOW_MS = 8, 60_000
FACE_MARGIN = 0.35

# Width over height by name; of equally near ones the earlier counts.
ASPECTS = (("21:9", 21 / 9), ("16:9", 16 / 9), ("3:2", 3 / 2), ("4:3", 4 / 3), ("5:4", 5 / 4), ("1:1", 1.0), ("4:5", 4 / 5), ("3:4", 3 / 4), ("2:3", 2 / 3), ("9:16", 9 / 16))

# Wording of captions and prompts, by code.
SHAPE_WORDS = {
    "round": "round implants giving even fullness and visible roundness in the upper breast",
    "teardrop": "anatomical teardrop implants giving a gently sloped upper breast and fuller lower pole, a natural-looking result",
}
PROFILE_WORDS = {
    "moderate": "a moderate profile with a wide base and gentle forward projection",
    "moderate-plus": "a balanced moderate-plus profile",
    "high": "a high profile with noticeable forward projection and a rounder look",
    "extra-high": "an extra-high profile with maximum forward projection",
}
BRAND_WORDS = {
    "mentor": "soft cohesive silicone gel implants with a natural feel",
    "natrelle": "cohesive silicone gel implants with pronounced, shape-holding upper fullness",
    "motiva": "modern ergonomic silicone implants that settle into a soft natural teardrop when upright",
    "sientra": "high-strength cohesive silicone gel implants",
}
DEFAULT_SHAPE_WORDS, DEFAULT_PROFILE_WORDS = "implants", "a balanced profile"
# Upper bounds of the volume bands, their wording in templates and in the interface.
BANDS = (250, 400, 550, 700)
BAND_PHRASES = (
    "a subtle increase of roughly half to one cup size",
    "a natural-looking increase of roughly one to one and a half cup sizes",
    "a clearly noticeable increase of roughly one and a half to two cup sizes",
    "a full increase of roughly two to two and a half cup sizes",
    "a dramatic increase of roughly two and a half or more cup sizes",
)
BAND_LABELS = (
    "Subtle — roughly half to one cup size",
    "Natural — roughly one to one and a half cup sizes",
    "Noticeable — roughly one and a half to two cup sizes",
    "Full — roughly two to two and a half cup sizes",
    "Dramatic — roughly two and a half or more cup sizes",
)
EDIT_SENTENCE = "Edit this photo to simulate the outcome of breast augmentation surgery with "
KEEP_SENTENCE = "Keep the person's identity, pose, skin tone, clothing, lighting and background exactly the same."
PROMPT_HEAD = "You are assisting a plastic-surgery consultation tool that shows patients a realistic preview of breast augmentation results."
PROMPT_BAND_TAIL = ", proportionate and anatomically plausible for this person's frame."
PROMPT_RULES = (
    "Strict requirements:",
    "- Only adjust the breast size and shape under the existing clothing.",
    "- Keep the person's identity, face, expression, pose, arms, skin tone, clothing, lighting and background exactly the same.",
    "- Keep the same camera angle, framing and image resolution.",
    "- The result must look like an unretouched photograph of the same person after surgery — realistic, tasteful and clinical, not exaggerated.",
    "Return only the edited image.",
)

# The catalogue's rows (id, name, manufacturer, fill, blurb, highlights).
BRANDS = (
    ("mentor", "Mentor", "Johnson & Johnson MedTech", "MemoryGel cohesive silicone", "One of the most widely used implant brands in the world, known for a soft, natural feel and a long safety track record.", ("Soft, natural feel", "Large long-term safety studies", "Round and shaped options")),
    ("natrelle", "Natrelle", "Allergan Aesthetics (AbbVie)", "Cohesive silicone gel (multiple gel softness levels)", "A broad portfolio with several gel cohesivity levels — from very soft to firmer, shape-holding “gummy” gel — so the look can be tuned from subtle to full.", ("Widest range of gel softness", "“Gummy” high-cohesivity options", "Many size and profile combinations")),
    ("motiva", "Motiva", "Establishment Labs", "SmoothSilk shell with adaptive ProgressiveGel (Ergonomix line)", "A newer-generation implant (FDA-approved in 2024) whose gel adapts to movement — rounder when lying down, teardrop when upright — for a particularly natural, dynamic look.", ("Adaptive gel that moves with you", "Very natural upright teardrop look", "Modern low-texture SmoothSilk surface")),
    ("sientra", "Sientra", "Tiger Aesthetics", "High-strength cohesive (HSC / HSC+) silicone gel", "US-made cohesive gel implants offered exclusively through board-certified plastic surgeons, with round and shaped lines.", ("High-strength cohesive gel", "Sold only via board-certified surgeons", "Round and shaped lines")),
)
# Profiles and shapes of the catalogue (id, name, blurb).
PROFILES = (
    ("moderate", "Moderate", "Wider base, gentler forward projection — the most understated silhouette."),
    ("moderate-plus", "Moderate plus", "A balanced middle ground — the most commonly chosen profile."),
    ("high", "High", "Narrower base with more forward projection for a fuller, rounder look."),
    ("extra-high", "Extra high", "Maximum projection from the narrowest base — the most dramatic option."),
)
SHAPE_ROWS = (
    ("round", "Round", "Even fullness top and bottom, more visible upper-pole roundness and cleavage."),
    ("teardrop", "Teardrop", "Tapered at the top, fuller at the bottom — mimics the natural slope of the breast."),
)

# What responses say.
SAYS = {
    "rate": "Too many previews in a short time. Please wait a minute and try again.",
    "large": "Photo is too large. Please use an image under 8 MB.",
    "json": "Invalid JSON body.",
    "photo": "Missing photo.",
    "mime": "Unsupported image format. Please upload a JPEG, PNG or WebP photo.",
    "config": "Invalid implant configuration.",
    "demo": "Demo mode: no AI key is configured, so this preview shows your original photo. Add a GEMINI_API_KEY to enable real previews.",
    "timeout": "The AI took too long to respond. Please try again.",
    "unreachable": "Could not reach the AI service. Please try again in a moment.",
    "busy": "The AI service is busy right now. Please wait a minute and try again.",
    "failed": "The AI service returned an error. Please try again.",
    "declined": "The AI declined to edit this photo. Please use a well-lit, front-facing photo in a fitted top or sports bra (no nudity), and try again.",
    "no_image": "The AI did not return an image. Please try again.",
    "file_type": "Please upload a JPEG, PNG or WebP photo.",
    "file_size": "That photo is over 20 MB. Please choose a smaller one.",
}
SMALL_TRAINING_SET = 500
