"""Vocabularies, word lists and patterns that results depend on."""

# Topics and the substrings that show them.
INTERESTS = {
    "gaming": ["jeu", "jeux", "game", "gaming", "steam", "ps4", "ps5", "xbox", "nintendo", "lol", "league of legends", "fortnite", "minecraft", "valorant", "gta", "fifa", "cod", "call of duty", "overwatch"],
    "music": ["musique", "music", "concert", "festival", "rap", "hip-hop", "techno", "playlist", "spotify", "album", "chanson", "track"],
    "sport": ["sport", "foot", "football", "soccer", "basket", "basketball", "tennis", "natation", "running", "course", "velo", "vélo", "gym", "fitness", "musculation", "rugby", "handball"],
    "travel": ["voyage", "travel", "vacances", "holiday", "trip", "paris", "london", "barcelona", "new york", "tokyo", "avion", "airport", "hotel", "airbnb", "roadtrip"],
    "cinema": ["film", "movie", "cinema", "série", "netflix", "amazon prime", "disney", "marvel", "anime", "manga"],
    "food": ["restaurant", "bouffe", "manger", "nourriture", "food", "pizza", "sushi", "burger", "cuisine", "recette", "recipe"],
    "tech": ["tech", "code", "programmation", "dev", "développeur", "developer", "python", "javascript", "react", "startup", "intelligence artificielle", "ia", "ai"],
    "party": ["fête", "soirée", "party", "bar", "club", "alcool", "bière", "beer", "vin"],
    "nature": ["randonnée", "hiking", "montagne", "mountain", "forêt", "forest", "plage", "beach", "camping", "nature", "trek"],
}

# Phrases and the importance they give a message.
IMPORTANCE = {"moved to": 0.8, "new job": 0.9, "got married": 1.0, "engaged": 0.9, "born": 0.9, "graduated": 0.9, "trip to": 0.7, "traveling to": 0.7, "started at": 0.8, "resigned": 0.8, "break up": 0.8, "broke up": 0.8, "bought a": 0.6, "apartment": 0.7, "house": 0.7}
IMPORTANCE_BASE = 0.1

# Emotions and the words that show them; the first emotion in this order wins.
EMOTION_WORDS = {
    "joy": ["happy", "excited", "love", "great", "wonderful", "amazing", "so nice"],
    "sadness": ["sad", "unhappy", "sorry", "miss", "grief", "bad news"],
    "anger": ["angry", "mad", "hate", "furious", "annoyed"],
    "fear": ["scared", "afraid", "worried", "nervous"],
    "surprise": ["wow", "omg", "shocked", "unbelievable"],
}

# The five emotions in the order that decides ties, with valence, arousal and dominance.
EMOTIONS = ["anger", "fear", "joy", "sadness", "neutral"]

# Phrases that tell where someone lives.
RESIDENCE = {
    "fr": ["habite", "maison", "chez moi", "mon appart", "mon studio", "adresse", "emménagé"],
    "en": ["live in", "my place", "my house", "my apartment", "my address", "moved to", "living in"],
}

# Words of each kind of relation, French and English.
RELATION_WORDS = {
    "PARTNER": ["mon amour", "chéri", "ma puce", "bébé", "ma femme", "mon mari", "je t'aime", "bisous partout", "my love", "honey", "baby", "my wife", "my husband", "i love you", "kisses"],
    "FAMILY": ["maman", "papa", "frère", "soeur", "cousin", "tante", "oncle", "mamie", "papi", "famille", "mom", "dad", "brother", "sister", "cousin", "aunt", "uncle", "grandma", "grandpa", "family"],
    "COLLEAGUE": ["bureau", "collègue", "réunion", "zoom", "slack", "cafétéria", "projet", "client", "rdv", "boulot", "office", "colleague", "meeting", "zoom", "slack", "cafeteria", "project", "client", "appointment", "work"],
}

# Beginnings of system messages and of reactions.
SYSTEM_STARTS = [
    "You joined", "You left", "You added", "You removed", "You changed", "You named", "You are now connected", "You waved at", "You can now message and call", "You started a (?:video )?call", "You called", "You missed a (?:video )?call",
    "You sent an? ", "You pinned a message", "You unpinned a message", "You created the group", "You set the (?:quick reaction|nickname)", "You set your nickname", "You turned (?:on|off)", "You accepted", "You declined", "You voted", "You took a screenshot",
    "This message was unsent", "This poll is no longer available", "Audio call", "Video call", "Missed (?:video )?call", r"The call ended\.", ".+ joined the (?:audio|video) call", "Say hi to", "Click for audio", "Click for video",
]
REACTION_STARTS = ["You reacted", "Liked a message", r".*\breacted\b .+ to your message"]

# Patterns of noise in personal messages.
NOISE = [
    "^click for audio", "^you sent an attachment", "^this message was unsent", "^this poll is no longer available", "missed your (audio |video )?call", r"^you called\b", "^the (video )?call ended", "^you (pinned|unpinned) a message", "^you created the group",
    "^you (joined|left) the (call|group|video chat)", "^you (added|removed|named|changed)", "^you are now connected", "^you can now message and call each other", "^you'?re now friends with", r"named the group\b", "changed the group photo", "added .+ as a group admin",
    "removed .+ as a group admin", "changed the chat theme", "set the emoji to", "created the group", "changed the group name", r"left the group\b", r"joined the group\b", r"added .+ to the group\b", r"removed .+ from the group\b", "^you waved at", "^you set the nickname",
    "^you set your nickname", "^you started a (call|video chat)", "^IP Address:", "https?://", r"www\.",
]

# Whole messages without content, and artefacts of the export.
STOCK = ["you ♥", "♥", "❤", "💕", "💗", "haha", "lol", "ok", "okay", "yes", "no", "yeah", "yep", "nope", "hmm", "ah", "oh", "wow", "omg", "idk", "brb", "ttyl", "k", "kk", "thx", "ty", "np", "gg", "lmao", "😂", "😊", "😍", "🥰", "😘", "👍", "👌", "🙏", "❤️", "💕", "💖", r"\?+", "!+", r"\.+"]
ARTEFACTS = ["sent a photo", "sent a video", "sent a sticker", "sent a GIF", "sent an attachment", "liked a message", r"You sent \$", "You sent a link", "is now connected on Messenger", "Say hi to your new Facebook friend", "waved at you", "This person is unavailable", "Click for audio", "Click for video", r"The call ended\.", ".+ joined the (?:audio|video) call", r".*\breacted\b .+ to your message", "You reacted", "Download file:"]

# Code point ranges of emoji.
EMOJI = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0xFE00, 0xFE0F), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x2600, 0x26FF), (0x200D, 0x200D), (0x1F90D, 0x1F9FF)]

# Device families: pattern and name, first match wins.
DEVICES = [("^android$", "Android"), ("iOS|iphone|ipad", "iOS"), ("web_player|web player", "Web Player"), ("windows", "Windows"), (r"os\s*x|macos|macintosh", "macOS"), ("linux", "Linux"), ("cast|chromecast", "Chromecast"), (r"tv|smart\s*tv", "Smart TV"), ("playstation|ps[345]", "PlayStation"), ("xbox", "Xbox")]

# Names of activity types.
ACTIVITIES = {
    "Run": "running",
    "Ride": "cycling",
    "Swim": "swimming",
    "Hike": "hiking",
    "Walk": "walking",
    "Workout": "fitness",
    "WeightTraining": "weight training",
    "VirtualRide": "virtual cycling",
    "VirtualRun": "virtual running",
    "Yoga": "yoga",
    "Rowing": "rowing",
    "Kayaking": "kayaking",
    "Skiing": "skiing",
    "Snowboard": "snowboarding",
    "IceSkate": "ice skating",
    "RockClimbing": "rock climbing",
    "Surfing": "surfing",
    "Elliptical": "elliptical",
    "StairStepper": "stair stepper",
    "Crossfit": "crossfit",
    "Soccer": "soccer",
    "Tennis": "tennis",
    "Golf": "golf",
    "Badminton": "badminton",
    "Squash": "squash",
    "Skateboard": "skateboarding",
    "InlineSkate": "inline skating",
    "Windsurf": "windsurfing",
    "Kitesurf": "kitesurfing",
    "Canoeing": "canoeing",
    "StandUpPaddling": "stand up paddling",
    "Handcycle": "handcycling",
    "Wheelchair": "wheelchair",
    "EBikeRide": "e-bike riding",
    "Velomobile": "velomobile",
    "MountainBikeRide": "mountain biking",
    "GravelRide": "gravel cycling",
    "TrailRun": "trail running",
    "NordicSki": "nordic skiing",
    "AlpineSki": "alpine skiing",
    "BackcountrySki": "backcountry skiing",
    "Snowshoe": "snowshoeing",
}

# What a notice of a group chat says after a name. NAME stands for another name, WORD for a word, WORDS for
# one to six words, REST for the rest of the sentence.
GROUP_NOTICES = [
    "created the group",
    "named the group REST",
    "named the group",
    "changed the group name",
    "changed the group photo",
    "added NAME to the group",
    "removed NAME from the group",
    "left the group",
    "set the nickname for NAME to WORDS",
    "set your nickname to WORDS",
    "set the emoji to WORD",
    "changed the chat theme",
    "changed the theme",
    "pinned a message",
    "started a call",
    "started a video call",
    "started an audio call",
    "sent a live location",
]
# Marks beside emoji that stand before the name of who reacted.
REACTION_MARKS = "♥❤💕💗💖💘💝💞💟♡👍🎉😂😢😮😡"

# Strings that mark roles and the ends of turns in formatted training texts.
ROLE_MARKS = ["<|start_header_id|>", "<|im_start|>", "[INST]", "<|user|>", "### Human:", "<|role|>"]
TURN_ENDS = ["<|eot_id|>", "<|im_end|>", "</s>", "[/INST]"]
