"""What counts as a letter."""

from fleetfold.llm import language


def test_symbols_above_the_base_plane_are_no_letters():
    emoji, old = "\U0001f600 \U0001f680\U0001f468\u200d\U0001f469", "\U00010330\U00020000"
    assert language.grams(emoji) is None and language.vector(emoji, None) is None
    assert language.grams(old) is not None
    plain, mixed = language.grams("kata moru"), language.grams("kata \U0001f600 moru")
    assert all((a == b).all() for a, b in zip(plain, mixed))
