from rankline.functions.columns import *  # noqa: F401,F403
