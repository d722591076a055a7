import gc

from jobsight.operators import extract as X


def test_a_tree_goes_with_its_page():
    """No cycles: without Python's cycle search nothing of a parsed page stays."""
    was = gc.isenabled()
    gc.collect()
    gc.disable()
    try:
        assert X.description_from_html('<body><div class="content"><p>a<b>c</p>d</div></span>e')[0] == "a\nc\nd"
        assert not [o for o in gc.get_objects() if isinstance(o, X._Node)]
    finally:
        if was:
            gc.enable()
