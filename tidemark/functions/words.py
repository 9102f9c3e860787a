"""Words that say nothing of a domain."""

from __future__ import annotations

import keyword

# Reserved words of JavaScript and TypeScript.
SCRIPT_WORDS = """
    break case catch class const continue debugger default delete do else export extends finally for function if import
    in instanceof let new return super switch this throw try typeof var void while with yield async await enum implements
    interface package private protected public static as from of readonly namespace declare abstract module require exports
""".split()
# Reserved words of Java.
JAVA_WORDS = """
    abstract assert boolean break byte case catch char class const continue default do double else enum extends final
    finally float for goto if implements import instanceof int interface long native new package private protected public
    return short static strictfp super switch synchronized this throw throws transient try void volatile while var record
    sealed permits yield
""".split()
# Names of a file's part in a program.
ROLE_WORDS = """
    index main app util utils helper helpers common core base test tests spec types config constants model models service
    services component components
""".split()
# Common words of programs.
GENERIC_WORDS = """
    get set add remove delete create update find list new init main run exec handle process parse build make test spec
    mock util utils helper helpers common core base impl abstract factory manager service controller handler provider
    wrapper adapter data info item items value values obj object type types class interface enum const var temp tmp foo bar
""".split()
# Words of frameworks.
FRAMEWORK_WORDS = """
    react component props state hook use django flask fastapi spring bean autowired express router route middleware
""".split()

STOPWORDS = sorted({*keyword.kwlist, *keyword.softkwlist, *SCRIPT_WORDS, *JAVA_WORDS, *ROLE_WORDS, *GENERIC_WORDS, *FRAMEWORK_WORDS})
