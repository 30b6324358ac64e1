"""No stream operator of its own: every source of the corpus work is a finite set of files.

The row-wise operators (cleaning, lexical measures, label rules, a fitted vectoriser or classifier) hold no state, so
they take a streaming DataFrame as it is.
"""
