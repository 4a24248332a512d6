"""Fixed values of intent routing: words and phrases that tell what a question asks for."""

# Phrases of each intent.
PHRASES = {
    "identity": (
        "سەن كىمسەن", "سىز كىمسىز", "ئۆزەڭنى تونۇشتۇر", "ئۆزۈڭنى تونۇشتۇر", "ئۆزىڭىزنى تونۇشتۇرۇڭ", "نامىڭ نېمە",
        "نامىڭىز نېمە", "ئىسمىڭ نېمە", "ئىسمىڭىز نېمە", "سەن كىم", "سىز كىم", "كىم سەن", "كىم سىز",
    ),
    "capabilities": (
        "نېمە قىلالايسەن", "نېمە قىلالايسىز", "نېمە ئىش قىلالايسەن", "نېمە ئىش قىلالايسىز", "قانداق ياردەم",
        "ياردەم بەرەلەمسەن", "ياردەم بەرەلەمسىز", "ئىقتىدارىڭ نېمە", "ئىقتىدارىڭىز نېمە", "نېمىلەرنى بىلىسەن",
        "نېمىلەرنى بىلىسىز", "نېمە ئۈچۈن ئىشلىتىلىدۇ", "سەن نېمە قىلىسەن",
    ),
    "author_by_title": (
        "مۇئەللىپى كىم", "كىم يازغان", "يازغۇچىسى كىم", "ئاپتورى كىم", "كىمنىڭ ئەسىرى", "كىمنىكى",
        "كىم تەرىپىدىن يازىلغان", "كىمنىڭ", "مۇئەللىپى", "يازغۇچىسى", "ئاپتورى",
    ),
    "books_by_author": (
        "نىڭ كىتابلىرى", "نىڭ قاندان ئەسەرلىرى", "ئەسەرلىرى قايسىلار", "كىتابلىرى قايسىلار",
        "قانچە كىتاب يازغان", "نەچچە ئەسەر يازغان", "يازغان كىتابلار", "يازغان ئەسەرلەر",
    ),
    "volume_info": (
        "نەچچە تومدىن", "قانچە تومدىن", "نەچچە توم", "قانچە توم", "توملار سانى", "قانچە بەتتىن", "نەچچە بەتتىن",
        "قانچە بەت", "نەچچە بەت", "توملىرى قانچە", "توملىرى نەچچە", "نەچچە قىسىمدىن", "قانچە قىسىمدىن",
        "نەچچە قىسىم", "قانچە قىسىم", "قىسىملار سانى", "قىسىملېرى قانچە", "قىسىملېرى نەچچە",
    ),
    "follow_up": (
        "ئۇ كىتاب", "شۇ كىتاب", "بۇ كىتاب", "ئۇ كىتابنىڭ", "شۇ كىتابنىڭ", "بۇ كىتابنىڭ", "ئۇ كىتابتىكى",
        "شۇ كىتابتىكى", "بۇ كىتابتىكى", "ئۇ كىتابتا", "شۇ كىتابتا", "بۇ كىتابتا", "ئۇ ئەسەر", "شۇ ئەسەر",
        "بۇ ئەسەر", "ئۇ ئاپتور", "شۇ ئاپتور", "بۇ ئاپتور", "ئۇ تومدا", "شۇ تومدا", "ئۇ قىسىمىدا", "شۇ قىسىمىدا",
        "بۇ قىسىمىدا", "بۇ تومدا", "ئۇ تومىدا", "شۇ تومىدا", "بۇ قىسىمدا", "ئۇ قىسىمدا", "يەنە", "داۋاملاشتۇر",
        "داۋامى", "تېخىمۇ", "قوشۇمچە", "مىسال كەلتۈر", "نىمىشقا", "نېمە ئۈچۈن", "كىمنى دىمەكچى", "نىمە دىمەكچى",
        "كەيىنكى قىسىم", "كېيىنكى قىسىم", "كەيىنكى توم", "كېيىنكى توم", "2-قىسىم", "3-قىسىم", "ئىككىنچى قىسىم",
        "ئۈچىنچى قىسىم", "بۇ شەخس", "بۇ پېرسوناژ", "بۇ قەھرىمان",
    ),
    "current_page": (
        "ئۇشبۇ بەتتە", "مەزكور بەتتە", "بۇ بەتتە",
    ),
    "current_volume": (
        "ئۇشبۇ تومدا", "ئۇشبۇ قىسىمدا", "مەزكور تومدا", "مەزكور قىسىمدا", "بۇ تومدا", "بۇ قىسىمدا",
    ),
    "catalog": (
        "مۇئەللىپ", "مۇئەللىپى", "يازغۇچى", "يازغۇچىسى", "ئاپتور", "ئاپتورى", "كىم يازغان", "يازغان كىشى",
        "يازغان كىم", "كىم تەرىپىدىن", "يازغانلىقى", "كىمنىڭ", "كىمنىكى", "ئەسەر يازغان", "ئەسەرلىرى",
        "كىتابلىرى", "كىتابلىرىڭىز", "كىتاب بارمۇ", "كىتابخانىڭىز", "كىتاب تىزىملىكى", "قانچە كىتاب",
        "نەچچە كىتاب", "قايسى كىتابلار", "قايسى ئەسەر",
    ),
}

# What makes a question with a catalog phrase one about contents.
CONTENT_SIGNALS = (
    "پېرسوناژ", "ئوبراز", "قەھرىمان", "قايسى ئەسەردىكى", "قايسى كىتابتا", "قايسى ئەسەردە", "قايسى كىتابدا",
)

# Words that refer back, and the ending that asks "what about".
PRONOUNS = (
    "ئۇ", "بۇ", "شۇ", "ئۇلار", "بۇلار", "شۇلار", "ئۇنىڭ", "بۇنىڭ", "شۇنىڭ", "ئۇنى", "بۇنى", "شۇنى", "ئۇنىڭدا",
    "شۇنىڭدا", "بۇنىڭدا", "ئۇنىڭدىن", "شۇنىڭدىن", "بۇنىڭدىن", "ئۇنىڭغا", "شۇنىڭغا", "بۇنىڭغا",
)
WHAT_ABOUT = "چۇ"

# Punctuation taken off question words; the letters of the alternation before case endings.
PUNCTUATION = "«»،؟!()[]{}\"“”‘’"
ENDS_AE, BECOMES = "\u06d5", "\u06cc"
