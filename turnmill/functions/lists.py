"""Lists that results depend on, one entry to a line."""

from __future__ import annotations

# Emoticons that the tokenizer doesn't find.
EMOTICONS = """
(งツ)ว
ಥ_ಥ
ಥ-ಥ
ಥ╭╮ಥ
(ಥ﹃ಥ)
ಥ~ಥ
ಥωಥ
ಥ﹏ಥ
ಠ‿ಥ
ಥ_ʖಥ
ಥ ͜ʖ ಥ
ಥoಥ
ಥ‿‿ಥ
ಥ◡ಥ
ಠ_ಥ
ಠ╭╮ಥ
ಥ益ಥ
ಠಿ_ಥ
ಥ ೧ ಥ
ಥ_ಠ
ಥ‿ಥ
ಥ∀ಥ
ಠωಥ
ಥ,_｣ಥ
ಥヮಥ
ಠಿ_ಠ
(ಥ◞⊱​◟ಥ)
(ಥ◞౪◟ಥ)
(ಥ_◞ಥ)
ᕦ(ಥ_ಥ)ᕤ
(˵ ͠ಥ‿ ͠ಥ˵)
ಇ(˵ಥ_ಥ˵)ಇ
೭(ಥ_ಥ)೨
(ง ͠ಥ_ಥ)ง
(ಽ ͡ಥ ͜ʖ ಥ)ಽ
ლ(ಥ益ಥლ)
Σ(ಥ_ಥ)
ヽ༼ಥ_ಥ༽ﾉ
(☞ ͡ಥuಥ)☞
( ಥ ʖ̫ ಥ)
( ͡ಥ‿ ಥ)━☆ﾟ.*･｡ﾟ
(ಥ_ಥ)━☆ﾟ.*･｡ﾟ
ಠ_ಠ
(ಠ_ಠ)
ಠ.ಠ
๏ ̯͡ ๏
(͠≖ ͜ʖ͠≖)
｡&#94;‿&#94;｡
|(•◡•)|
¯\\\\(ツ)/¯
""".strip("\n").split("\n")

# Dull responses; $1 and the like stand for any words.
DULL = """
i do n't know .
i do n't know what you 're talking about .
i do n't know what you mean .
i do n't know what you mean by that .
i do n't know , i just do n't get it .
i do n't know if you 're being sarcastic or not .
i do n't know if you 're joking or not .
i do n't know if it 's a joke $1
i do n't know what you mean by that answer .
i do n't know why you think that .
i do n't know , i 've never heard of it .
i 'm sorry , i 'm not sure what you mean . i 'm not sure what you 're saying .
i 'm sorry , i do n't know what you 're talking about .
i 'm not sure .
i 'm not sure if i 'm being a $1
i 'm not sure if it 's worth it , but i 'm not sure if it 's worth it .
i 'm not sure if that 's a joke or not .
i 'm not sure if that 's a good idea or not .
i 'm not sure if you 're being sarcastic or not .
i 'm not sure if you 're joking or not .
i 'm not sure how that works , but i 'm not sure .
i 'm not sure how you can do that .
i 'm not sure how $1
i 'm not sure what the point is . i 'm just saying that $1
i 'm not sure what to do with this .
i 'm not sure what you mean by $1
i 'm not sure what you mean by that . i 'm just saying that $1
i 'm not sure what you 're saying .
i 'm not sure what you 're talking about .
i 'm not sure what you 're trying to say .
i 'm not sure what you mean by that .
i 'm not sure what you mean by this .
i 'm not sure what you mean .
i 'm not sure , but i 'm not sure if it 's worth it .
i 'm not sure . i 'm pretty sure it 's $1
i 'm not even sure how to respond to this .
i 'm not trying to be a dick , i 'm just trying to say $1
i do n't understand what you mean . i 'm not saying $1
i 'm not saying that , but i 'm saying that $1
i 'm not saying it 's a bad thing , but it 's not a good thing .
i 'm not saying it 's a bad thing , but i 'm not saying it 's $1
i 'm not saying it 's $1 , but i 'm not saying $1
i 'm not saying it 's not true . i 'm saying that $1
i 'm not saying it 's not a bad thing , but i 'm saying that $1
i 'm not saying you 're wrong , but i 'm saying that you 're $1
i 'm in the same boat .
i 'm not the only one who $1
i 'm not going to be a dick , but i 'm not going to be a dick .
i 'm not a huge fan of the $1, but $1
i have no idea what you 're talking about , but i 'm not sure if $1
""".strip("\n").split("\n")
